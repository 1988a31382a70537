"""Operators for training data: filters, scans, near duplicates, token files and packing."""
