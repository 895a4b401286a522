"""Spark-native engine for finding and accounting for sensitive data."""
