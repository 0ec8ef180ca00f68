"""Operators over indexed arrays: DataFrame in, DataFrame out."""
