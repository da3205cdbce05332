"""Whole analyses, and graphs derived from the driver's tables."""
