"""Spark-native de-identification of document collections."""
