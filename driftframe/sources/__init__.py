"""Catalog views and sources."""
