"""Relational operators that Spark has under another shape."""
