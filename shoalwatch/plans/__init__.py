"""Schemas, semantic types, column mapping, analysis suites and workspaces."""
