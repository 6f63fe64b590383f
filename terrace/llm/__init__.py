"""Operators for preparing text corpora: counting, filtering, deduplicating, scanning and packing."""
