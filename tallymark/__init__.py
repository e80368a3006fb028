"""Reconciliation of published figures against their source tables, on Spark.

Captures (what a report shows), specs (what to check) and sources (the tables
behind it) are all DataFrames; verdicts come back as DataFrames.
"""

__version__ = "0.1.0"
