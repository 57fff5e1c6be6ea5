"""Spark-native analytics over test-adequacy experiment records."""
