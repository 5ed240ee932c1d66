"""Relational operators beyond Spark's own."""
