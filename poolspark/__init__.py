"""Spark-native analytics for pool-based sample acquisition."""
