"""Spark-native governed retrieval and event analytics."""

__version__ = "0.1.0"
