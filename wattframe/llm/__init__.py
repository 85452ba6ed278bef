"""Operators on training corpora: sharding, deduplication, filtering, mixing and packing."""
