"""Corpus operators for large-scale training-data preparation."""
