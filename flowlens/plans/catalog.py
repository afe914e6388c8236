"""All registered queries."""

from __future__ import annotations

from . import file_queries, io_queries, pipeline_queries, report_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
