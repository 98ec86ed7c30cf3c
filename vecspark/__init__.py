"""Spark-native engine for compressing, indexing and searching embedding vectors."""

__version__ = "0.1.0"
