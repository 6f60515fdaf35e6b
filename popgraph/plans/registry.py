"""Query registry: each name has a Spark plan and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from popgraph.sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}

_VIEW_NAME = re.compile(r"\bq_\w+")


def view(name: str, body: str) -> None:
    """A named sub-query that other SQL texts may use; names start with q_."""
    VIEWS[name] = body


def with_views(body: str) -> str:
    """Put the sub-queries a text uses, directly or not, in front of it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_VIEW_NAME.findall(text)):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    rest = body.strip()
    if rest[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{rest[5:]}"
    return f"WITH {ctes}\n{rest}"


def plan(name: str, sql: str | None = None):
    """Register a plan over `Tables` under `name`."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in SQL.items()}
