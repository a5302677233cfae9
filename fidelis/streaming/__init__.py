"""Streaming forms: frame joins and running means over Structured Streaming."""
