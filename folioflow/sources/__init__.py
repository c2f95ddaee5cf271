"""Readers of pages, side tables, events, evaluation cases and registries; writers of indexes, reports and traces."""
