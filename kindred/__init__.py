"""Spark-native record linkage analytics."""
