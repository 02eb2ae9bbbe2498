"""Query compilation."""
