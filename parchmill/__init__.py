"""parchmill: Spark-native analytics for large collections of filing texts."""

__version__ = "0.1.0"
