"""Composite checks and reports."""
