"""Spark-native analytics over engineering knowledge, code facts and event streams."""
