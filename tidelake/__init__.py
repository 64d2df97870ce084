"""A Spark-native engine for append-only event logs."""

__version__ = "0.1.0"
