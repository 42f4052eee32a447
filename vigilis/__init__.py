"""Surveillance analytics as PySpark operators."""
