"""Operators that prepare training text: mixing, filtering, deduplication, extraction, token files."""
