"""Structured Streaming over job events and resource samples."""
