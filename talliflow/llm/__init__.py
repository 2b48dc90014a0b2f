"""Operators on training texts; nothing outside this folder imports them."""
