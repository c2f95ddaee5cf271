"""Spark jobs for versioned wiki indexing, batch retrieval and evaluation."""
