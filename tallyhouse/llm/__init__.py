"""Operators over large text corpora: deduplication, packing, mixing, scoring and sharding."""
