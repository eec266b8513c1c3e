"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; its queries and their
SQL live in :mod:`tallywood.llm.queries`.
"""
