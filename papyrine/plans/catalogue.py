"""All core queries with their SQL."""

from __future__ import annotations

from papyrine.plans import record_queries, report_queries, training_data  # noqa: F401 - record_queries adds to those of report_queries

QUERIES: dict = {**report_queries.QUERIES, **training_data.QUERIES}
ORACLES: dict = {**report_queries.ORACLES, **training_data.ORACLES}
