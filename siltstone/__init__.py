"""Siltstone: a Spark-native engine for document retrieval, evidence and corpus analytics."""
