"""gaugework: usage-log analytics for data platforms, written for Spark.

Operators are plain functions ``op(df, ..., as_of=...) -> DataFrame``.  Nothing
inside an operator runs an action or converts to pandas; the caller decides
when the plan executes.
"""
