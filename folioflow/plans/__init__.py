"""Composed plans and the catalogue of queries over the driver tables."""
