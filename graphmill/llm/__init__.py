"""Operators for preparing training data from text and vectors.

Nothing outside this package imports it; the queries are in :mod:`graphmill.llm.queries`.
"""
