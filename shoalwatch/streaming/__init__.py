"""Unbounded variants of the windowed analyses."""
