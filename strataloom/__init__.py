"""A Spark-native engine for source-text extraction artifacts and corpus preparation."""

__version__ = "0.1.0"
