"""Queries over the benchmark tables."""
