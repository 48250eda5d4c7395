"""Spark-native analytics for aerial surveys."""
