"""Operators for preparing training text: deduplication, scoring, mixing, packing, search."""
