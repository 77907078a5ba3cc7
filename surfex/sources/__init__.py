"""Readers with fixed schemas and new-only sinks."""
