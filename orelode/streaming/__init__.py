"""Structured Streaming forms of the keyed aggregations."""
