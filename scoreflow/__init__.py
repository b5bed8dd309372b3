"""Spark-native toolkit for credit-risk style binary classification on large tables."""
