"""Operators over the catalog, its index and the ingest log."""
