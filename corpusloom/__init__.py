"""Spark-native preparation, profiling and search of large text corpora."""
