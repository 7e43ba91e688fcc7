"""Queries by id, with their SQL equivalents."""
