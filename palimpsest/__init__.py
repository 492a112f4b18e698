"""Spark-native analytics over long-lived knowledge records."""
