"""User functions on workers: scorers with a deadline (R25), scorers by name, functions over chunks.

* ``score_with_deadline`` calls a Python scorer for each row inside the task and stops a call
  that takes too long: the row scores 0 with a reason, the others are scored as if it were
  not there.
* ``named_scorer`` finds a scorer by module and function name; the module must be installed on
  the executors.
* ``map_chunks`` gives a function consecutive chunks of at most ``chunk_rows`` rows, each in
  order, and checks what it returns.
"""

from __future__ import annotations

import contextlib
import importlib
import signal
import threading
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .index import with_global_index


class DeadlinePassed(BaseException):
    """Raised inside a call; no ``Exception``, so that the scorer's own handlers let it through."""


@contextlib.contextmanager
def deadline(seconds: float):
    """Ends the block after ``seconds`` by an alarm, and again and again should it go on.

    Python code stops at once, a call into a library when it comes back.  Alarms need the
    main thread, where workers run their tasks.
    """
    if threading.current_thread() is not threading.main_thread():
        raise RuntimeError("a deadline needs the main thread of a worker")

    def stop(signum, frame):
        raise DeadlinePassed
    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def scored_row(scorer: Callable[..., float], args: tuple, seconds: float) -> tuple[float, str | None]:
    """Score and reason of one row: no reason, ``timeout``, ``no score`` or ``error: <its kind>``."""
    try:
        with deadline(seconds):
            value = scorer(*args)
    except DeadlinePassed:
        return 0.0, "timeout"
    except Exception as e:  # a failed score is 0 by rule, whatever failed
        return 0.0, f"error: {type(e).__name__}"
    if isinstance(value, (tuple, list)):
        value = value[0] if value else None
    return (0.0, "no score") if value is None or value != value else (float(value), None)


def score_with_deadline(df: DataFrame, scorer: Callable[..., float] | NamedScorer, columns: list[str], seconds: float,
                        score: str = "score", reason: str = "reason") -> DataFrame:
    """``df`` with the scorer's value of the columns and the reason of a 0 that it did not give.

    Rows of an Arrow batch are scored one after the other, each with the whole deadline, so a
    task of n rows takes n deadlines at most.  Raises ValueError where a new column exists.
    """
    if {score.lower(), reason.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {score}, {reason} exist; name others")

    def run(batches):
        call = scorer.resolve() if isinstance(scorer, NamedScorer) else scorer  # imports take no row's time
        for batch in batches:
            found = [scored_row(call, args, seconds) for args in zip(*(batch.column(c).to_pylist() for c in columns))]
            extra = [pa.array([s for s, _ in found], pa.float64()), pa.array([r for _, r in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, score, reason])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(score, "double").add(reason, "string"))


@dataclass(frozen=True)
class NamedScorer:
    """A scorer by the names of its module and function; each task looks it up once."""
    module: str
    function: str

    def resolve(self) -> Callable[..., float]:
        found = getattr(importlib.import_module(self.module), self.function, None)
        if not callable(found):
            raise ValueError(f"{self.module} has no function {self.function}")
        return found


def named_scorer(module: str, function: str) -> NamedScorer:
    """ValueError here, not in a task, where there is no such function."""
    found = NamedScorer(module, function)
    found.resolve()
    return found


def map_chunks(df: DataFrame, function: Callable[[pa.Table], pa.Table], schema: StructType, chunk_rows: int, order_cols) -> DataFrame:
    """The rows that ``function`` makes of each chunk of ``df``.

    Rows are numbered in the order of ``order_cols`` (unique together); chunk c holds the rows
    c * chunk_rows to (c + 1) * chunk_rows - 1, sorted, so chunks are the same in every run and
    no task holds more than one at a time.  The function gets the columns of ``df`` as a table
    and must return a table of ``schema`` (names, order and types), else the job fails.
    """
    if chunk_rows < 1:
        raise ValueError("a chunk has one row at least")
    names, want = list(df.columns), to_arrow_schema(schema)
    ranked = with_global_index(df, order_cols, "_chunk_row")
    ranked = ranked.withColumn("_chunk", F.floor(F.col("_chunk_row") / chunk_rows).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        made = function(table.sort_by("_chunk_row").select(names))
        found = [(f.name, f.type) for f in made.schema]
        if found != [(f.name, f.type) for f in want]:
            raise TypeError(f"the function returned {found}, not {[(f.name, f.type) for f in want]}")
        return made

    return ranked.groupBy("_chunk").applyInArrow(run, schema)
