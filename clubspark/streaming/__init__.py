"""Structured Streaming forms of the row-by-row updates."""
