"""Spark-native analytics over step-by-step reasoning traces."""

__version__ = "0.1.0"
