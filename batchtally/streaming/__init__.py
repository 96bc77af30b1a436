"""Structured Streaming forms of the poll loop."""
