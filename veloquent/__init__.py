"""Spark-native transcript analytics and training-data operators."""
