"""Captured responses and stored catalogs."""
