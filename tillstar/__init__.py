"""tillstar: retail sales quality, cleaning, star-schema merge and BI queries on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from the DataFrame
API, so Catalyst plans it and the same code runs in batch or inside a
Structured Streaming ``foreachBatch``.
"""

__version__ = "0.1.0"
