"""Ledger analytics on Spark: statement scans, an exact-decimal ledger, and the questions asked of it, as lazy DataFrames."""
