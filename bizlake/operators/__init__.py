"""Operators over DataFrames: DataFrame in, DataFrame out."""
