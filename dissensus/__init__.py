"""Spark operators for evaluating repeated, disagreeing labels."""
