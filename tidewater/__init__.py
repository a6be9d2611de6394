"""Tidewater: a PySpark-native engine for e-commerce logs, change records and training-data corpora."""
