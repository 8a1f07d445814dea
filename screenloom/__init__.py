"""Spark-native analytics over screen text, activity logs and model answers."""
