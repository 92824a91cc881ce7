"""Registry of queries and of the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datavigil.plans.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; the views named in `sql` are put in front of it as common table expressions."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text):
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in needed)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"(?i)^with\s+recursive\b", "", body)
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\b", "", body)
    return f"WITH {ctes}\n{body}"
