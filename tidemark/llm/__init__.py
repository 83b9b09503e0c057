"""Operators for large training-text corpora. Nothing else in tidemark imports this package."""
