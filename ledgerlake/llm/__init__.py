"""Operators for training-data pipelines: search, deduplication, filters, formatting, mixing, counts."""
