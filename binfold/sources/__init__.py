"""Readers and writers of interval, alignment, metadata and report files."""
