"""Quillon: document analytics on PySpark DataFrames."""
