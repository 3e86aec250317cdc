"""Spark-native document retrieval, question answering and evaluation."""
