"""Spark-native signal-to-sequence analytics: DataFrames in, DataFrames out."""

__version__ = "0.1.0"
