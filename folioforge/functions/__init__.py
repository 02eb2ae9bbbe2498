"""Text functions as Columns."""
