"""Registered queries: a name, a function of (spark, folder), and SQL for the check if there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name."""
    def register(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"query {plan.__name__} is registered twice")
        QUERIES[plan.__name__] = Query(plan, sql)
        return plan
    return register
