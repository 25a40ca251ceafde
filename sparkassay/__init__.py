"""Spark-native dataset profiling, schema inference and validation."""
