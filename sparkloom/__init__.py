"""Spark-native hybrid ranking, evaluation and text-pipeline engine."""
