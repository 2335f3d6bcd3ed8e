"""Spark-native preparation and analysis of speech text, token and sample streams."""
