"""Spark-native document retrieval, curation and analytics."""
