"""Spark operators: each returns a DataFrame or column expressions."""
