"""Daily time-series analytics for many series at once, on Spark DataFrames.

Every operator is ``(DataFrame, ..., key=[...]) -> DataFrame``, lazy, and runs for all
series together; a *series* is the rows of one key, at most one row per key and day.
"""
