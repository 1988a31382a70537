"""The same work on pages that keep arriving."""
