"""Lodestone: a PySpark-native analytics engine for corpora of code and text."""
