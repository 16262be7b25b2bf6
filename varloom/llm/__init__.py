"""Operators that prepare training text: cleaning, deduplication, classification and packing."""
