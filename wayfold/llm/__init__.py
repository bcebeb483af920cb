"""Operators of a training-data pipeline: deduplication, tokenising, packing,
filtering and formatting of large text tables."""
