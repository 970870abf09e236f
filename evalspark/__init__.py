"""evalspark: staff-evaluation scoring, documents, table changes and workflow on Spark.

Subpackages:
    functions  scalar rules as Column expressions
    sources    declared-schema table reads/writes and JSON document shredding
    operators  scoring, grading, joins/listings, documents, table changes, workflow, integrity
    streaming  the save log as a Structured Streaming job
    plans      registered queries (with DuckDB oracle SQL) over the fixture tables
"""

__version__ = "0.1.0"
