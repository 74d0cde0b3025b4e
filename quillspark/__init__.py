"""Spark-native engine for searching, maintaining and exploring note collections."""

__version__ = "0.1.0"
