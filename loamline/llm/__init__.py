"""Training-data operators: scoring, packing, near-duplicates, extraction, filtering and mixing.

Nothing else in the library imports this subpackage.
"""
