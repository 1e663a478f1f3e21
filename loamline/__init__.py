"""Loamline: a Spark-native document lake, retrieval and analytics engine."""

__version__ = "0.1.0"
