"""Operators for preparing training data: cleaning, deduplication, search, classification and tokens."""
