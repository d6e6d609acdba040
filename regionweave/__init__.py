"""Relational spatial and interval reasoning on PySpark DataFrames."""
