"""Scalar functions over columns: text, keys and similarity."""
