"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a chunk wherever it is -1 modulo the block
size; each chunk gives one of 64 letters.  The block size is the smallest of 3 * 2**k that
is at least a LETTERS-th of the text's bytes, so a signature has about LETTERS letters (more
only where a text repeats itself with many boundaries in each period).  The signature at
that size and at the doubled one make the fingerprint ``block:signature:signature``.
Boundaries of a doubled block size are a subset, so the text is hashed once.

Two fingerprints are compared at block sizes that both have.  Runs of more than three equal
letters are cut to three.  Signatures without a common run of COMMON letters (of a third of
the shorter one and at least two, if that is less) are unlike; otherwise likeness is
1 - edits / total letters, counting insertions and deletions (a replacement is both).

Cases: null and empty texts have the fingerprint of the empty text; equal texts have equal
fingerprints and likeness 1; texts of any length are hashed whole; documents with equal ids
are ordered by text, so repeated rows follow each other.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Spans
from .support import written

WINDOW = 7
LEAST = 3  # smallest block size
LETTERS = 64
COMMON = 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
RUNS = re.compile(r"(.)\1{3,}")

def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = data.size
    if n == 0:
        return "3::"
    spans = Spans(data)
    after = np.arange(1, n + 1)
    rolling = spans(np.maximum(after - WINDOW, 0), after)
    # a third of the hash range times a power of two: residue -1 modulo 3 * 2**k
    third = rolling % np.uint64(3) == np.uint64(2)
    high = rolling // np.uint64(3)
    ends = np.flatnonzero(third[:-1]) + 1
    level = high[:-1][third[:-1]]

    def signature(cuts: np.ndarray) -> str:
        edges = np.concatenate(([0], cuts, [n]))
        letters = spans(edges[:-1], edges[1:]) >> np.uint64(58)
        return "".join(map(ALPHABET.__getitem__, letters.tolist()))

    k = max(0, math.ceil(math.log2(max(n, 1) / (LEAST * LETTERS))))
    fine, wide = (level & np.uint64(m) == np.uint64(m) for m in ((1 << k) - 1, (2 << k) - 1))
    return f"{LEAST << k}:{signature(ends[fine])}:{signature(ends[wide])}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the letters of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    a, b = RUNS.sub(r"\1\1\1", a), RUNS.sub(r"\1\1\1", b)
    if a == b:
        return 1.0
    need = min(COMMON, max(2, min(len(a), len(b)) // 3))
    runs = {a[k:k + need] for k in range(len(a) - need + 1)}
    if not any(b[k:k + need] in runs for k in range(len(b) - need + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 (unlike, or no block size in common) to 1 (equal fingerprints)."""
    if a == b:
        return 1.0
    (block_a, fine_a, wide_a), (block_b, fine_b, wide_b) = a.split(":"), b.split(":")
    small, large = int(block_a), int(block_b)
    found = []
    if small == large:
        found = [(fine_a, fine_b), (wide_a, wide_b)]
    elif small == 2 * large:
        found = [(fine_a, wide_b)]
    elif large == 2 * small:
        found = [(wide_a, fine_b)]
    return max((signature_likeness(x, y) for x, y in found), default=0.0)


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare(text: str, own: str, after: str, after_print: str) -> dict:
    cut = len(text) // 4
    edited = text[:len(text) - cut] + after[:cut]
    print_edited = own if edited == text else fingerprint(edited)
    return {"n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
            "fingerprint": own, "edited_fingerprint": print_edited,
            "near_edited": likeness(own, print_edited), "near_next": likeness(own, after_print)}


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and RESULT for each document against the next one in ascending order.

    Ranges of doc_id are sorted each in a task that streams them, holding one document.  The
    last document of a range needs the first of the next range: tasks hand both on as rows
    of the written result, two texts a task, which a second, small step compares.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = frame.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    first, last = "first", "last"

    def stream(batches):
        part, held, count = TaskContext.get().partitionId(), None, 0
        names = [f.split()[0] for f in RESULT.split(", ")]

        def row(doc, kind, body=None, result=None):
            return {"part": part, "kind": kind, "doc_id": doc, "body": body} | (result or dict.fromkeys(names))
        for batch in batches:
            out = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                now = (doc, t, fingerprint(t))
                if held is None:
                    out.append(row(doc, first, t))
                else:
                    out.append(row(held[0], None, None, compare(held[1], held[2], t, now[2])))
                held = now
            yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row(held[0], last, held[1])], schema)

    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    from pyspark.sql.pandas.types import to_arrow_type
    schema = pa.schema([("part", pa.int64()), ("kind", pa.string()),
                        ("doc_id", to_arrow_type(docs.schema[doc_id].dataType)), ("body", pa.string()),
                        *[(f.split()[0], arrow[f.split()[1]]) for f in RESULT.split(", ")]])
    steps = written(ordered.mapInArrow(stream, f"part long, kind string, doc_id {id_type}, body string, {RESULT}"),
                    "fingerprint-steps")
    inner = steps.filter("kind is null").drop("part", "kind", "body")
    heads = steps.filter(F.col("kind") == first).select("part", F.col("body").alias("next_body"))
    tails = steps.filter(F.col("kind") == last).select("part", "doc_id", "body")
    # the parts that hold rows, in a ring: a few bytes for each task
    parts = [r[0] for r in heads.select("part").orderBy("part").collect()]
    ring = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next_part long")
    pairs = (tails.join(ring, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part")
             .select("doc_id", "body", "next_body"))

    def finish(batches):
        for batch in batches:
            out = []
            for doc, t, after in zip(*(c.to_pylist() for c in batch.columns)):
                out.append({"doc_id": doc} | compare(t, fingerprint(t), after, fingerprint(after)))
            yield pa.RecordBatch.from_pylist(out, pa.schema([schema.field("doc_id"), *list(schema)[4:]]))

    return inner.unionByName(pairs.mapInArrow(finish, f"doc_id {id_type}, {RESULT}"))
