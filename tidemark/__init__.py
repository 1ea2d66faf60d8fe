"""Spark-native engine for hierarchical time series and for training-data work."""
