"""Tidemark: a PySpark-native engine for point-in-time forecasting data."""

__version__ = "0.1.0"
