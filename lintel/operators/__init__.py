"""Operators from files to findings, metrics, deltas and reports."""
