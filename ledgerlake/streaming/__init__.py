"""Structured Streaming ingest into the Bronze table."""
