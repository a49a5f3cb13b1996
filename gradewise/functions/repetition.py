"""The repetition score of whole texts, from their suffix arrays.

``score = 2 * sum(LCP) / (n (n + 1))`` over the code points of a text, where LCP are the lengths
that neighbours in the sorted order of its suffixes share; above 0.2 a text repeats itself.

The suffixes of all texts of a piece of an Arrow batch are sorted together by prefix doubling:
ranks by the first 1, 2, 4, ... characters, each from pairs of the ranks before, until no two
suffixes of a text share a rank.  The ranks of all steps then give the common prefixes of
neighbours, the longest power of two first.  ``O(n log n log r)`` for a longest repeat of ``r``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .common import as_col

#: Characters sorted together; a longer text is sorted alone.
PIECE_CHARS = 1 << 18
REPEATS_ABOVE = 0.2


def shared_prefix_sums(texts: list[str]) -> np.ndarray:
    """For each text the sum of the common prefix lengths of neighbouring suffixes."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    size = np.array([c.size for c in codes], np.int64)
    total = int(size.sum())
    if not total:
        return np.zeros(len(texts), np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(total)
    rank = np.unique(np.concatenate(codes), return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while True:
        # the second half of the window, -1 where the text has ended before it
        second = np.where(at + width < end, rank[np.minimum(at + width, total - 1)], -1) + 1
        key = rank * (total + 1) + second
        order = np.lexsort((key, of))
        new = np.ones(total, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():  # of one text no two suffixes are equal, so this comes to an end
            break
        levels.append(rank)
        width *= 2
    a, b = order[:-1], order[1:]
    same = of[a] == of[b]
    a, b = a[same], b[same]
    shared = np.zeros(a.size, np.int64)
    for step in range(len(levels) - 1, -1, -1):
        inside = (a + shared < end[a]) & (b + shared < end[b])
        ra, rb = levels[step][np.minimum(a + shared, total - 1)], levels[step][np.minimum(b + shared, total - 1)]
        # beyond the first step equal ranks are of one text; two of its suffixes that end early differ
        shared += np.where(inside & (ra == rb), 1 << step, 0)
    return np.bincount(of[a], shared, len(texts)).astype(np.int64)


def repetition_scores(texts: list[str]) -> list[float]:
    out, held, chars = [], [], 0

    def flush():
        for t, s in zip(held, shared_prefix_sums(held)):
            out.append(2 * int(s) / (len(t) * (len(t) + 1)) if len(t) > 1 else 0.0)
    for t in texts:
        if held and chars + len(t) > PIECE_CHARS:
            flush()
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        flush()
    return out


def repetition_score(text) -> Column:
    """The score of each whole text; 0 for texts of at most one character and for null."""
    @arrow_udf("double")
    def repeated(texts: pa.Array) -> pa.Array:
        return pa.array(repetition_scores([t or "" for t in texts.to_pylist()]), pa.float64())
    return repeated(as_col(text))
