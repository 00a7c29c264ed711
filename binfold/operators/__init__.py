"""Operators over long tables keyed by sample, chromosome and bin."""
