"""Spark-native analytics for timed text, intervals and per-record metrics."""
