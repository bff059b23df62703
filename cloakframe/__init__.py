"""Spark-native masking and restoring of confidential words in text and tables."""
