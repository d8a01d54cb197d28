"""Structured Streaming ingest and bounded series dedup."""
