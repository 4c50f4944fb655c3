"""Operators for large training corpora: search, filters, deduplication, mixing and packing."""
