"""Bounded incremental aggregation."""
