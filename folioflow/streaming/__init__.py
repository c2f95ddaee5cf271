"""Structured Streaming jobs and the stateful rules that batches share with them."""
