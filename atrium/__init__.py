"""Spark-native spatial and semantic scene analytics."""
