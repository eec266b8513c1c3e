"""Scalar functions as Column builders; none runs Python on rows."""
