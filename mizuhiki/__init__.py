"""Spark-native cleansing and entity resolution for business listings."""
