"""lodestar: set-at-a-time document retrieval, re-ranking and evaluation on Spark.

Every operator takes and returns DataFrames built from built-in expressions;
no operator collects to the driver or runs per-row Python.
"""

__all__ = ["session"]
