"""Spark-native operators for entity-and-period data."""
