"""Scalar column functions and the row-expression translator."""
