"""Operators for large text corpora: language, duplicates, privacy, packing, extraction."""
