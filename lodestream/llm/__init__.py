"""Operators that prepare training text: duplicates, filters, extraction, mixing, packing."""
