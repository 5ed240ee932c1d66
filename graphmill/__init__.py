"""Spark-native knowledge-graph queries and the data processing around them."""

__version__ = "0.1.0"
