"""Spark-native engine for conversational memory: graph, retrieval and corpus operators."""

__version__ = "0.1.0"
