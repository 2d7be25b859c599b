"""batchwright: Spark-native toolkit for daily batch pipelines on warehouse tables.

Subpackages
-----------
sources    reading tables, partition/versioned writes, read-back verification
functions  column functions: business dates, templates, log parsing, casts
operators  table operators: dedup-latest, as-of lookup, policy check, audits
plans      whole jobs (the company dimension) and the query registry
streaming  Structured Streaming variants of the trigger/state operators
"""

__all__ = ["session"]
