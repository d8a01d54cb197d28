"""Queries over the provided tables, shaped into export requests, and their SQL answers."""
