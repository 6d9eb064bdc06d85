"""Spark-native analytics for financial reconciliation: DataFrame operators only."""
