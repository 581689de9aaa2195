"""Spark-native code search, evidence and evaluation analytics."""

__version__ = "0.1.0"
