"""Outputs: part files and the skip log."""
