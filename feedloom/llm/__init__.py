"""Operators for training-data pipelines: filters, deduplication, scoring, encoding."""
