"""Operators for preparing training data: scans, filters, near-duplicates, mixing, archives, tokens."""
