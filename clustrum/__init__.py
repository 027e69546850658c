"""Partitional clustering on PySpark."""
