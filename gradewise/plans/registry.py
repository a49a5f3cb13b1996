"""Registry of catalogued queries: id -> Spark plan, id -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query id {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import (credit, metrics, batch, scoring, prep, balance,  # noqa: F401
                   puzzles, analysis, io, streams, tokens, perturb_checks)
