"""larkspur: Spark-native streaming vector search."""

__version__ = "0.1.0"
