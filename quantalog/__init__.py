"""Spark-native analytics over cryptographic inventories."""
