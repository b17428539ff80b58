"""Constraint audit engine on PySpark DataFrames."""
