"""Training-data operators: filtering, deduplication, scoring, tokenising and packing.

Nothing outside this subpackage imports it.
"""
