"""Every query of the engine by name, with the SQL it equals."""

from __future__ import annotations

from paritylens.plans import branch_queries, channel_queries, detect_queries, log_queries, table_queries  # noqa: F401 - they register their queries
from paritylens.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
