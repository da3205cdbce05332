"""Incremental analysis."""
