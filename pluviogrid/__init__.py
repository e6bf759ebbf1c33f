"""Spark-native analytics for gridded and station time series."""
