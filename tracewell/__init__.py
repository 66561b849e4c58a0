"""Spark-native evidence retrieval, assembly and validation."""

__version__ = "0.1.0"
