"""Spark-native analytics for crawled websites."""
