"""Structured Streaming forms of the metric roll-ups."""
