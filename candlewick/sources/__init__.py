"""Readers and writers of the exchange formats: bars, ticks, deals, equity, metadata, probes and reports."""
