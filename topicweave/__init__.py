"""Spark-native analytics for probabilistic text models."""
