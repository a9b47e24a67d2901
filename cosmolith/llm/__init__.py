"""Operators for preparing training data: sharding, language, duplicates, counts, packing, quality, mixing, private data."""
