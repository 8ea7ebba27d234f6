"""lodewell: a PySpark-native document retrieval and analytics engine."""

__version__ = "0.1.0"
