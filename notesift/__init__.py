"""Spark-native clinical text analytics."""
