"""Catalog search, ingest accounting and training-data operators on Spark."""
