"""Operators that prepare training text: language, duplicates, contamination, packing, scores."""
