"""Spark-native analysis of language-model evaluation runs."""
