"""Spark-native engine for cataloguing document collections."""
