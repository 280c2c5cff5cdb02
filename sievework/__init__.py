"""Spark-native dataset audit engine."""

__version__ = "0.1.0"
