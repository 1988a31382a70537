"""Column functions: no joins, no shuffles, nothing outside the row."""
