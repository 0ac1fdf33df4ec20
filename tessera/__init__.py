"""Tessera: a Spark-native engine for question-to-query datasets and text corpora."""
