"""The table queries: one per operator, each with the SQL that must agree."""
