"""Readers and writers: tracks, forecasts, places, trip records."""
