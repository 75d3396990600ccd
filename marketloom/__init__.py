"""Spark-native analytics over bitemporal price panels."""
