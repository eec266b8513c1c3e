"""Operators over the ledger: DataFrames in, lazy DataFrames out."""
