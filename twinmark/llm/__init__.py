"""Operators for preparing training text: counting, packing, filtering, deduplicating, scoring."""
