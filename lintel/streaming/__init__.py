"""Incremental scans and stateful limits."""
