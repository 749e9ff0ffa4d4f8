"""Scans and sinks: landed raw files, clean tables, summaries, CSV exports."""
