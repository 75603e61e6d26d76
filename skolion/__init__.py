"""Spark-native engine for document collections: retrieval, graphs, evaluation, streams."""

__version__ = "0.1.0"
