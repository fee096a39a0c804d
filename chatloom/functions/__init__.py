"""Column functions: text, casts, periods, row hashes."""
