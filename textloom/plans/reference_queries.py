"""All registered queries on the reference's operators."""

from __future__ import annotations

from textloom.plans import format_queries, metric_queries, set_queries, text_queries  # noqa: F401 they register their queries
from textloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
