"""Readers of requests and stored tables, and the writers that lay the tables out."""
