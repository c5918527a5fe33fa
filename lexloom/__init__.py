"""Spark-native text routing, retrieval and corpus analytics."""

__version__ = "0.1.0"
