"""Corpus operators for training data: mixing, packing, deduplication, search, scoring and binary output.

Nothing outside this package imports it; it can be removed as a whole.
"""
