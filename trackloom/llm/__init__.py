"""Operators for large text corpora: cleaning, de-duplication, scoring, search, packing, archives."""
