"""Palimpsest: a PySpark-native engine for archived assistant conversations."""

__version__ = "0.1.0"
