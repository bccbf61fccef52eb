"""Operators on tables: selection, limits, counts, appending and updating rows."""
