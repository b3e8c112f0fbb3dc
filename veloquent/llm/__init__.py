"""Operators for large training-data corpora: dedup, extraction, filters, scoring, mixing, packing."""
