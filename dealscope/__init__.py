"""Spark-native analytics for sales-pipeline tables: DataFrame in, DataFrame out."""
