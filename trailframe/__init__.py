"""Spark-native analytics over tracks, multi-day trips, forecasts and text corpora."""
