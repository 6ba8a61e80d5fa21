"""Spark-native web-page audit and page-text processing engine."""

__version__ = "0.1.0"
