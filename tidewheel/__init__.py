"""Spark-native period search over many irregularly sampled series."""
