"""Operators on training documents; nothing else in the library imports them."""
