"""Checks of the engine against DuckDB."""
