"""mediasift: social-media content analysis over tables, built on Spark.

Every per-request decision (contract checks, URL policy, manifest checks,
record flattening, evidence numbering, text understanding, tagging, caching,
auditing) is a DataFrame operator keyed by ``request_id``.
"""

__version__ = "0.1.0"
