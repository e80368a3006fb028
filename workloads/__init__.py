"""Registered queries with their SQL counterparts."""

from workloads import (  # noqa: F401
    aggregates, catalogs, charts, checks, figures, inventories, kpi_specs, reconciliation, runlogs,
    source_io, spec_tables, table_specs,
)
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
