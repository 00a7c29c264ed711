"""Workflows and the registered queries with their SQL."""
