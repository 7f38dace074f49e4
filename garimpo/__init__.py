"""Spark-native text retrieval, document structuring and evaluation engine."""
