"""Checked queries: every operator on the given tables, with SQL to compare against."""

from lorespark.checks import (  # noqa: F401
    catalog_checks,
    graph_checks,
    retrieval_checks,
    scalar_checks,
    source_checks,
    stream_checks,
)
from lorespark.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
