"""Whole jobs: ingest of a batch of requests into the six tables."""
