"""Spark-native analytics over program-structure tables."""
