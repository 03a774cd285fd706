"""Retail traffic and sales analytics on PySpark DataFrames."""
