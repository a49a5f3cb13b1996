"""Small shared helpers for Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def rnd(c, digits: int = 6) -> Column:
    """Round doubles for comparisons across engines (sums are order dependent)."""
    return F.round(as_col(c).cast("double"), digits)


def stable_hash(*parts) -> Column:
    """Deterministic 64-bit hash, the seeded randomness of this library."""
    return F.xxhash64(*[as_col(p) for p in parts])


def let(value, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Expression builders that mention a sub-expression several times would
    otherwise copy it into every use (and nested rules multiply the copies);
    binding it through a one-element ``transform`` keeps the work per row
    linear.
    """
    return F.element_at(F.transform(F.array(as_col(value)), fn), 1)


def seeded_digits(key, seed: int, *more) -> Column:
    """The 15 hex digits of ``seeded_draw``; as text they sort like the number."""
    parts = [as_col(p).cast("string") for p in (key, *more)]
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15)


def seeded_draw(key, seed: int, *more) -> Column:
    """Seeded pseudo-random integer in [0, 2^60) for a key (and more key parts).

    The leading 15 hex digits of an md5 over seed and key parts: every seed gives an
    unrelated order, keys of any size are told apart, and any engine with md5
    reproduces it.
    """
    return F.conv(seeded_digits(key, seed, *more), 16, 10).cast("long")


def seeded_sql(key_sql: str, seed: int, *more: str) -> str:
    """SQL text of ``seeded_draw`` (for oracle queries in other engines)."""
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST(({p}) AS VARCHAR)" for p in (key_sql, *more)]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
