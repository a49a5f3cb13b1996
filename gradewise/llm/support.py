"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import threading
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.session import ensure_checkpoint_dir

#: Bytes of text that numpy code handles at once; a single longer document is handled alone.
PIECE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster in ``spark.checkpoint.dir``; an error where it is unset
    (in local mode a folder is made).

    It holds every written intermediate, so it must be visible to all executors.
    """
    active = ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or active).rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder (not created)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage.

    The table lives in shared storage, so lost executors cost nothing that was finished.
    The schema is handed to the reader, which also makes empty results readable.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a driver with little to do
    rarely does; without this a job of many steps keeps the shuffles of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Hand at most ``rows`` rows to Python at once while plans run inside; texts are long, and
    both sides of the exchange hold whole batches.  A smaller setting stays as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    limit_arrow_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def unused(df_or_names, *wanted: str) -> list[str]:
    """Column names starting with ``wanted`` that no column of the frame has (case ignored)."""
    names = getattr(df_or_names, "columns", df_or_names)
    taken = {c.lower() for c in names}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow array, null as empty."""
    return [x or "" for x in column.to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows (null: empty row)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def row_pieces(column: pa.Array, limit: int = PIECE_BYTES):
    """(first row, one past the last row) of runs of rows with at most ``limit`` bytes of text."""
    _, offsets = byte_view(column)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def local_path(uri: str) -> tuple[object, str]:
    """pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return fs.LocalFileSystem(), os.path.abspath(uri)


#: Rows that stages hand to Python at once.
STAGE_ROWS = 500


def limit_arrow_batches(spark: SparkSession, rows: int = STAGE_ROWS) -> None:
    """Let plans of this session hand at most ``rows`` rows to Python at once from now on.

    A stage returns a plan that its caller runs later, so a setting that ends with the stage
    (``arrow_batches``) would come too early; a smaller setting stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "0") or 0)
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: The C library's names for the size from which memory is mapped, and for what may
#: stay free at the end of the heap.
M_MMAP_THRESHOLD, M_TRIM_THRESHOLD = -3, -1

#: Seconds in which a worker that used next to no CPU time counts as idle.
IDLE_SECONDS = 2.0

_caches: list = []
_operator: str | None = None


def worker_cache(load):
    """Remember what ``load`` returns (codecs, vocabularies) while the process works for one operator."""
    cached = functools.lru_cache(maxsize=4)(load)
    _caches.append(cached)
    return cached


def give_back() -> None:
    """Empty the caches; freed memory goes back to the system."""
    for cached in _caches:
        cached.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has this
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _watch() -> None:
    """An executor keeps more workers than it has cores at work; one that waits gives back what it held."""
    global _operator
    used = time.process_time()
    while True:
        time.sleep(IDLE_SECONDS)
        before, used = used, time.process_time()
        if _operator and used - before < IDLE_SECONDS / 50:
            _operator = ""
            give_back()


def working_for(operator: str) -> None:
    """Called by an operator's functions in a worker.  Workers live on from operator to operator; what
    they held for the one before goes, and freed memory goes back to the system, also when they wait."""
    global _operator
    if _operator == operator:
        return
    if _operator is None:
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has these
            libc = ctypes.CDLL("libc.so.6")
            # large arrays get pages of their own, which go back when they are freed; those of a
            # piece of text are smaller and reuse the heap
            libc.mallopt(M_MMAP_THRESHOLD, 4 << 20)
            libc.mallopt(M_TRIM_THRESHOLD, 32 << 20)
        threading.Thread(target=_watch, daemon=True).start()
    elif _operator:
        give_back()
    _operator = operator
