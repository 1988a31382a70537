"""Whole runs, composed from operators."""
