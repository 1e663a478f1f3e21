"""Transformations over DataFrames."""
