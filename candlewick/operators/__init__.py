"""Operators over bars, signals, trades and reports."""
