"""Statements over growing tables: the pull cursor, as a Structured Streaming query."""
