"""Unbounded logs of contacts."""
