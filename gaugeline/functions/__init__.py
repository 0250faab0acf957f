"""Scalar functions, as Columns."""
