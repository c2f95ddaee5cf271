"""Column functions: hashes, text rules and small date and cache helpers."""
