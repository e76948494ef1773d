"""Spark-native data-integrity analytics: DataFrame in, DataFrame out."""
