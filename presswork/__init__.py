"""Spark-native analytics for a news-content pipeline."""
