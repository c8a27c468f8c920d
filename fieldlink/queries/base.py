"""Registry of checked queries: a Spark callable and, where SQL can say it, a DuckDB twin.

The SQL side is written on its own, from the driver tables up, out of named
common table expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *needs: str, columns: str = "") -> None:
    CTES[name] = (needs, text, columns)


_SHARED: dict[tuple, object] = {}


def shared(fn):
    """Build tables that several queries start from once per session.

    They are written tables, so later queries read them like any input.  The
    bench calls :func:`forget` before each timing.
    """

    @functools.wraps(fn)
    def once(spark, sf):
        key = (fn.__module__, fn.__name__, spark.sparkContext.applicationId, sf)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, sf)
        return _SHARED[key]

    return once


def forget() -> None:
    _SHARED.clear()


def with_ctes(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for n in CTES[name][0]:
            visit(n)
        ordered.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n}{CTES[n][2]} AS ({CTES[n][1]})" for n in ordered)
    return (f"WITH RECURSIVE {parts}\n" if parts else "") + body


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *needs)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns; adding zero turns -0.0 into 0.0."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        out.append(((F.round(c, digits) + 0.0).alias(field.name)) if field.dataType.typeName() in ("double", "float") else c)
    return df.select(*out)


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def settled(df: DataFrame) -> DataFrame:
    """Floating columns to nine places, so that a value halfway between two rounded ones does not hang on its last bits."""
    return rounded(df, 9)


def settled_sql(expr: str, name: str, digits: int = 6) -> str:
    return r(f"round(CAST({expr} AS DOUBLE), 9)", name, digits)
