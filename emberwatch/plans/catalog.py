"""All registered queries."""

from __future__ import annotations

from emberwatch.plans import event_queries, graph_queries, knowledge_queries, parsing_queries, rule_queries  # noqa: F401
from emberwatch.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
