"""Column-to-Column functions; all JVM built-ins unless a docstring says otherwise."""
