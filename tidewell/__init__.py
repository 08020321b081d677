"""Spark-native analytics engine: collections, folds, transactions, streams."""
