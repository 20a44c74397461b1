"""Incremental runs over a growing folder."""
