"""Operators over the record tables: DataFrames in, DataFrame out."""
