"""Whole flows put together from operators and sources."""
