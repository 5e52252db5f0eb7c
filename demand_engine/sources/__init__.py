"""Inputs: wide sales files and the given parquet tables; the parquet store."""
