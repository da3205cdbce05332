"""Operators on code graphs."""
