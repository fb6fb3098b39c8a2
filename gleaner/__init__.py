"""Spark-native curation of large document streams."""
