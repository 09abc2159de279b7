"""Readers that yield one row per document."""
