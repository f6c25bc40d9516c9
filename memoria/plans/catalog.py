"""Every query of the library, and the SQL to hold it against."""

from __future__ import annotations

from memoria.plans import conversations, evaluation, facts, graph, relational, retrieval, rollups, scope, streams, text, tools  # noqa: F401
from memoria.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
