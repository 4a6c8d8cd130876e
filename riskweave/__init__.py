"""Spark-first analytics for transaction streams and tables."""
