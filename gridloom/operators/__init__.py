"""Operators over grid tables: DataFrame in, DataFrame out."""
