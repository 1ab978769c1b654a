"""Indicators: window expressions, and recurrences read as streams."""
