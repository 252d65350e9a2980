"""Readers, writers and the views over the benchmark tables."""
