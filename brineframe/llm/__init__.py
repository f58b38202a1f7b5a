"""Operators for large text corpora: screening, deduplication, scoring, tokens."""
