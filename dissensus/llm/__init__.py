"""Operators for large text corpora: deduplication, filters, tokens and archives."""
