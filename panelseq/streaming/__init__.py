"""Structured Streaming forms of the updaters."""
