"""Spark-native analytics over source repositories and relational tables."""
