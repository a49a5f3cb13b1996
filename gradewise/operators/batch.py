"""Batch algebra (B1-B23) over DataFrames with an explicit position column.

A batch is a DataFrame plus a 0-based position column (``idx``; see
``index.with_global_index``) and an optional metadata dict kept beside it.
Positional operators read and write that column; none of them collects rows.
Row counts the operators need are scalar subqueries, so they are computed by
the cluster and never pass through Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_col, seeded_draw
from .index import row_count, with_global_index

IDX = "idx"


@dataclass
class Batch:
    """A DataFrame with a position column and the reference's ``meta_info``."""
    df: DataFrame
    meta: dict = field(default_factory=dict)
    idx: str = IDX

    @classmethod
    def from_frame(cls, df: DataFrame, order_cols, meta: dict | None = None, idx: str = IDX):
        return cls(with_global_index(df, order_cols, idx), dict(meta or {}), idx)


# --- B1 / B2: construction and checks ----------------------------------------

def from_columns(spark, columns: dict[str, list], schema=None) -> DataFrame:
    """B1: build from a dict of equal-length lists (small literal batches only)."""
    lengths = {k: len(v) for k, v in columns.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"columns have different lengths: {lengths}")
    n = next(iter(lengths.values()), 0)
    rows = [tuple(columns[k][i] for k in columns) for i in range(n)]
    df = spark.createDataFrame(rows, schema=schema or list(columns))
    return with_global_index(df.withColumn("_at", F.monotonically_increasing_id()), "_at", IDX).drop("_at") if n else df


def consistency_report(df: DataFrame, required: list[str], array_lengths: dict[str, int] | None = None) -> DataFrame:
    """B2: one aggregate row: total rows, rows with a NULL in a required column,
    rows whose array columns do not have the expected length."""
    null_any = F.lit(False)
    for c in required:
        null_any = null_any | F.col(c).isNull()
    bad_len = F.lit(False)
    for c, n in (array_lengths or {}).items():
        bad_len = bad_len | (F.size(c) != n)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.when(null_any, 1).otherwise(0)).cast("long").alias("n_null_rows"),
                  F.sum(F.when(bad_len, 1).otherwise(0)).cast("long").alias("n_bad_length_rows"))


def assert_consistent(df: DataFrame, required: list[str]) -> DataFrame:
    """B2 as a guard: rows pass through, a NULL required field raises."""
    cond = F.lit(True)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    return df.filter(F.assert_true(cond, F.lit("batch consistency check failed")).isNull())


# --- B3-B5: projection -----------------------------------------------------------

def select_keys(df: DataFrame, keys: list[str], idx: str = IDX) -> DataFrame:
    """Keep the named columns (and the position)."""
    return df.select(idx, *keys) if idx in df.columns and idx not in keys else df.select(*keys)


def pop(df: DataFrame, keys: list[str], idx: str = IDX) -> tuple[DataFrame, DataFrame]:
    """(popped columns, the rest); unknown keys raise."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"unknown keys {missing}")
    return select_keys(df, keys, idx), df.drop(*keys)


def rename(df: DataFrame, old: list[str] | str, new: list[str] | str) -> DataFrame:
    """Rename columns; the two name lists must have the same length."""
    old = [old] if isinstance(old, str) else list(old)
    new = [new] if isinstance(new, str) else list(new)
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names but {len(new)} new names")
    return df.withColumnsRenamed(dict(zip(old, new)))


# --- B6 / B7: union and concat ----------------------------------------------------

def union(left: DataFrame, right: DataFrame, key: str = IDX,
          left_meta: dict | None = None, right_meta: dict | None = None) -> DataFrame:
    """Add ``right``'s columns to ``left`` row by row (matched on ``key``).

    Shared columns must be equal (NULL-safe, NaN equals NaN) and both sides
    must hold the same rows; violations raise at execution.  Conflicting
    metadata raises immediately.
    """
    for k in set(left_meta or {}) & set(right_meta or {}):
        if left_meta[k] != right_meta[k]:
            raise ValueError(f"meta_info key {k!r} differs")
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns if c != key],
                     F.lit(True).alias("_r_present"))
    l = left.withColumn("_l_present", F.lit(True))
    j = l.join(r, key, "full_outer")
    ok = F.col("_l_present").isNotNull() & F.col("_r_present").isNotNull()
    for c in shared:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    # a filter (not a dropped column) so the optimizer cannot prune the check
    j = j.filter(F.assert_true(ok, F.lit("union: row sets or shared columns differ")).isNull())
    return j.drop("_l_present", "_r_present", *[f"_r_{c}" for c in shared])


def concat(frames: list[DataFrame], idx: str = IDX) -> DataFrame:
    """Concatenate batches in list order; positions continue across parts."""
    out, before = None, F.lit(0)
    for f in frames:
        # the rows before it, counted by the cluster; nothing is sorted again
        part = f.withColumn(idx, F.col(idx) + before) if idx in f.columns else f
        before = before + row_count(f)
        out = part if out is None else out.unionByName(part)
    return out


# --- B8-B15: positional reshaping -----------------------------------------------

def chunk(df: DataFrame, chunks: int, idx: str = IDX) -> DataFrame:
    """``chunk_id`` of ``chunks`` equal contiguous parts; indivisible counts raise."""
    n = row_count(df)
    size = F.when(n % chunks == 0, (n / chunks).cast("long")).otherwise(
        F.raise_error(F.format_string(f"%d rows cannot be cut into {chunks} equal chunks", n)))
    return df.withColumn("chunk_id", (F.col(idx) / size).cast("long"))


def repeat(df: DataFrame, times: int, interleave: bool = True, idx: str = IDX) -> DataFrame:
    """Each row ``times`` times, next to each other (interleave) or tiled."""
    n = row_count(df)
    rep = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    new = F.col(idx) * times + F.col("_rep") if interleave else F.col("_rep") * n + F.col(idx)
    return rep.withColumn(idx, new.cast("long")).drop("_rep")


def reorder(df: DataFrame, order: DataFrame, idx: str = IDX, new_idx: str = "new_idx") -> DataFrame:
    """``order`` maps (new_idx -> old idx); rows move to their new positions."""
    return (df.join(order.select(F.col(new_idx).alias("_new"), F.col(idx)), idx)
              .drop(idx).withColumnRenamed("_new", idx))


def slice_rows(df: DataFrame, start, stop, idx: str = IDX) -> DataFrame:
    """Rows with ``start <= idx < stop``, renumbered from 0."""
    start, stop = as_col(start), as_col(stop)
    return df.filter((F.col(idx) >= start) & (F.col(idx) < stop)).withColumn(idx, F.col(idx) - start)


def pad_to_divisor(df: DataFrame, divisor: int, idx: str = IDX) -> tuple[DataFrame, Column]:
    """Append copies cycling from the start until the count divides ``divisor``.

    Returns the padded frame (``is_pad`` marks added rows) and the pad size as
    a scalar column.  Row j of the padding copies row ``j mod n``.
    """
    n = row_count(df)
    pad = F.pmod(-n, F.lit(divisor))
    base = df.withColumn("is_pad", F.lit(False))
    extra = (df.filter(F.col(idx) < pad)
               .withColumn(idx, F.explode(F.sequence(n + F.col(idx), n + pad - 1, n)))
               .withColumn("is_pad", F.lit(True)))
    return base.unionByName(extra), pad


def unpad(df: DataFrame, pad, idx: str = IDX) -> DataFrame:
    """Drop the last ``pad`` rows."""
    n = row_count(df)
    return df.filter(F.col(idx) < n - as_col(pad))


def fold(df: DataFrame, group_size: int, idx: str = IDX, sub: str = "sub_idx") -> DataFrame:
    """Reshape (n rows) -> (n/group_size groups of group_size), contiguous.

    Kept in long form: ``idx`` becomes the group position and ``sub`` the
    position inside the group, so a fold never gathers a group into one
    array (the reference's ``new_batch_size`` is ``n / group_size``).
    The group size must divide the row count.
    """
    n = row_count(df)
    k = F.when(n % group_size == 0, F.lit(group_size).cast("long")).otherwise(
        F.raise_error(F.lit("group size must divide the row count")))
    return (df.withColumn(sub, F.pmod(F.col(idx), k))
              .withColumn(idx, (F.col(idx) / k).cast("long")))


def unfold(df: DataFrame, group_size: int, idx: str = IDX, sub: str = "sub_idx") -> DataFrame:
    """Inverse of ``fold``: flat positions restored from (group, sub)."""
    return df.withColumn(idx, F.col(idx) * group_size + F.col(sub)).drop(sub)


def collate(df: DataFrame, batch_col: str, cols: list[str], idx: str = IDX) -> DataFrame:
    """Rows of a batch -> one row of per-column lists in position order."""
    s = df.groupBy(batch_col).agg(F.sort_array(F.collect_list(F.struct(idx, *cols))).alias("_rows"))
    return s.select(batch_col, *[F.transform("_rows", _field_getter(c)).alias(c) for c in cols])


def _field_getter(name: str):
    return lambda r: r[name]


# --- B17-B19: iteration plans ----------------------------------------------------

def minibatch_plan(df: DataFrame, key: str, mini_batch_size: int, epochs: int,
                   shuffle_seed: int | None = None, idx: str = IDX) -> DataFrame:
    """(epoch, batch_id, position in batch) per row for ``epochs`` passes.

    Sequential by position unless a seed is given; then each epoch has its own
    seeded order.  The mini-batch size must divide the row count.
    """
    n = row_count(df)
    ep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if shuffle_seed is None:
        ranked = ep.withColumn("_r", F.col(idx))
    else:
        ep = ep.withColumn("_h", seeded_draw("epoch", shuffle_seed, key))
        ranked = with_global_index(ep, ["epoch", "_h", key], "_g").withColumn("_r", F.col("_g") - F.col("epoch") * n)
    ok = F.when(n % mini_batch_size == 0, F.lit(mini_batch_size)).otherwise(
        F.raise_error(F.lit("mini batch size must divide the row count")))
    return (ranked.withColumn("batch_id", (F.col("_r") / ok).cast("long"))
                  .withColumn("pos_in_batch", F.pmod(F.col("_r"), F.lit(mini_batch_size)))
                  .drop("_r", "_h", "_g"))


def shuffled_batches(df: DataFrame, key: str, batch_size: int, seed: int, drop_last: bool = True) -> DataFrame:
    """Seeded shuffled sampler; the last partial batch is dropped."""
    ranked = with_global_index(df.withColumn("_h", seeded_draw(key, seed)), ["_h", key], "_r")
    n = row_count(df)
    out = ranked.withColumn("batch_id", (F.col("_r") / batch_size).cast("long"))
    if drop_last:
        out = out.filter(F.col("batch_id") < (n / batch_size).cast("long"))
    return out.drop("_h")


def shard_for_ranks(df: DataFrame, world_size: int, position: str = IDX, drop_last: bool = True) -> DataFrame:
    """Data-parallel rank = position mod world; tail beyond a full round dropped."""
    n = row_count(df)
    out = df.withColumn("rank", F.pmod(F.col(position), F.lit(world_size)))
    if drop_last:
        out = out.filter(F.col(position) < (n / world_size).cast("long") * world_size)
    return out


# --- B20-B23 -----------------------------------------------------------------------

def byte_size(df: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Bytes of numeric columns (by width), strings (UTF-8 length) and arrays."""
    widths = {"bigint": 8, "double": 8, "int": 4, "float": 4, "smallint": 2, "tinyint": 1, "boolean": 1,
              "timestamp": 8, "timestamp_ntz": 8, "date": 4}
    parts = []
    for name, dtype in df.dtypes:
        if dtype == "string":
            parts.append(F.coalesce(F.octet_length(name), F.lit(0)).cast("long"))
        elif dtype.startswith("array<"):
            inner = dtype[6:-1]
            parts.append(F.coalesce(F.size(name), F.lit(0)).cast("long") * widths.get(inner, 8))
        else:
            parts.append(F.lit(widths.get(dtype, 8)).cast("long"))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.groupBy(*(group_by or [])).agg(F.sum(total).alias("n_bytes"))


def prompt_uid(*key_cols) -> Column:
    """Deterministic id per prompt (kept by ``repeat``), SHA-256 of the key text."""
    return F.sha2(F.concat_ws("\u0001", *[as_col(c).cast("string") for c in key_cols]), 256)


def append_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The values of each key in ``order``, as long-form (key, pos, value).

    The reference appends to one Python list per key; a table keeps the list
    as rows with their position, so a hot key is never gathered into a single
    row.  Positions come from the global index (range partitioned)."""
    ranked = with_global_index(df.select(key, order, value), [key, order], "_g")
    first = ranked.groupBy(key).agg(F.min("_g").alias("_first"))
    return (ranked.join(first, key).withColumn("pos", F.col("_g") - F.col("_first"))
                  .select(key, "pos", value))
