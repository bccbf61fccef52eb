"""Column functions: how values are rendered as text, and date serials."""
