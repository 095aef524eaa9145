"""Siltstone: a PySpark-native engine for building, checking and querying document corpora."""
