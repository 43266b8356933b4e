"""Spark-native analytics: pure functions over DataFrames, no global session."""
