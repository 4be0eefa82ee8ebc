"""Spark-first analytics over notices, pages and event tables."""
