"""Registry of the named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded for comparison; the added zero removes negative zeros."""
    x = F.col(c) if isinstance(c, str) else c
    out = F.round(x, digits) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def q(e: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL form of ``r``."""
    return f"round({e}, {digits}) + 0.0::DOUBLE AS {name or e}"
