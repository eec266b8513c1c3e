"""Ingest, feedback and recategorisation as Structured Streaming queries."""
