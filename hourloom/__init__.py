"""Spark-native operators for event and time-series analytics.

Every operator takes and returns DataFrames, keeps no global state, and is a
plain composition of joins, aggregates, windows and column expressions.
"""

__version__ = "0.1.0"
