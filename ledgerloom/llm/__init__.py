"""Operators that prepare training text: scoring, duplicates, leaks, mixing, token files."""
