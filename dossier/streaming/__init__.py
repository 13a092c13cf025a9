"""Structured Streaming forms of the append and page-reading paths."""
