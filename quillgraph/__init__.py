"""Spark-native analytics over evidence-backed relationship graphs."""
