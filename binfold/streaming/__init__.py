"""Incremental forms of the counting operators."""
