"""Operators for large training-data pipelines (quality, deduplication, filtering, output)."""
