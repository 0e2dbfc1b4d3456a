"""Tessera: a PySpark-native engine for rule research on OHLC bar series."""
