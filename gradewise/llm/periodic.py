"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period ``q`` whose length is at least
``max(min_length, min_periods * q)`` and that no neighbouring word extends with that period.

The words are appended one by one to a suffix automaton.  The suffix links are a tree in
which the node of a prefix is below those of all its suffixes, so the path from the root to
the newest prefix holds every suffix of the text so far.  A link-cut tree keeps for each node
the last place where its suffixes ended: an access recolours the path to the newest prefix,
and meets the old colours in segments.  A segment of colour ``j`` whose lowest node stands for
``m`` words says that the last ``m`` words ended before at ``j``, and no more of them do: with
``p = i - j`` the last ``m + p`` words have period ``p``, and for ``m >= p`` a square of
period ``p`` ends here and ``p`` is the smallest period (a smaller one would have ended the
same words later than ``j``).  The stretch cannot be extended to the left; where the next word
differs from the one ``p`` before it, it is a whole run.  A text of ``n`` words takes
``O(n log n)`` steps.

Before that, ``stretches`` leaves out words that cannot be in a run: all three-word windows of
a run, but for the first ones, repeat at most a period earlier, and a period is at most a
third of their number.  The remaining stretches hold every run whole.

Cases: null, empty and blank texts have no words and no runs; a text of any length is taken
whole, memory grows with the longest stretch that repeats itself (about 0.6 KB a word);
repeated rows are treated alike; an empty table gives an empty result; columns that clash
with the new one make it take another name, which is returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import strings, unused

MIN_LENGTH, MIN_PERIODS = 6, 4
RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def words_of(text: str) -> list[bytes]:
    """The maximal pieces without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


class LastOccurrences:
    """Suffix automaton of the words appended so far, whose link tree is a link-cut tree.

    Arrays are indexed by node; 0 is no node, 1 the root.  ``left``, ``right`` and ``up`` are
    the splay trees of the tree's paths in order of depth, and ``up`` of a splay tree's root is
    the node above the path.  ``colour`` is that of the whole path, kept at its splay root.
    """

    def __init__(self):
        self.size, self.link, self.next = [0, 0], [0, 0], [{}, {}]
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [0, 0]
        self.last, self.time = 1, 0

    def _node(self, size: int, following: dict) -> int:
        for a in (self.link, self.left, self.right, self.up, self.colour):
            a.append(0)
        self.size.append(size)
        self.next.append(following)
        return len(self.size) - 1

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:  # x is now the root of the splay tree
            self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def _clone(self, q: int, size: int) -> int:
        """A node for the shorter suffixes of ``q``, between it and its parent in the tree and on
        the same path, as both have ended at the same places."""
        c = self._node(size, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        self._splay(q)
        above = self.left[q]
        self.left[c] = above
        if above:
            self.up[above] = c
        self.left[q], self.up[c] = c, q
        return c

    def append(self, word: int) -> list[tuple[int, int]]:
        """(j, m) of every coloured segment on the path of the new prefix, lowest first: its last
        m words ended last at place j (places count from 1), and so did no more of them."""
        size, link, following = self.size, self.link, self.next
        self.time += 1
        p, cur = self.last, self._node(self.time, {})
        while p and word not in following[p]:
            following[p][word] = cur
            p = link[p]
        if not p:
            parent = 1
        else:
            q = following[p][word]
            if size[q] == size[p] + 1:
                parent = q
            else:
                parent = self._clone(q, size[p] + 1)
                while p and following[p].get(word) == q:
                    following[p][word] = parent
                    p = link[p]
        link[cur] = self.up[cur] = parent
        self.last = cur
        return self._access(cur)

    def _access(self, x: int) -> list[tuple[int, int]]:
        right, up, colour, size, splay = self.right, self.up, self.colour, self.size, self._splay
        segments, below = [], 0
        while x:
            splay(x)
            if colour[x] and size[x]:
                segments.append((colour[x], size[x]))
            cut = right[x]
            if cut:
                colour[cut] = colour[x]  # the rest of the old path keeps its colour
            right[x], below, x = below, x, up[x]
        colour[below] = self.time
        return segments


def runs_in(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words; periods of ``min_periods`` >= 2."""
    found, n = [], len(words)
    automaton = LastOccurrences()
    for i, word in enumerate(words, 1):
        for j, m in automaton.append(word):
            p = i - j
            if m + p >= max(min_length, min_periods * p) and (i == n or words[i] != words[i - p]):
                found.append((i - m - p, m + p, p))
    return found


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of disjoint stretches that hold every run of length >= max(6, 4 periods)
    whole, with a word more on either side (where there is one)."""
    n = ids.size
    if n < MIN_LENGTH:
        return []
    x = ids.astype(np.uint64)
    window = x[2:] + x[1:-1] * np.uint64(0x9E3779B97F4A7C15) + x[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return []
    # how far back the same window was; a clash of hashes makes it smaller, which keeps more
    back = np.full(window.size, n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    marked = back < n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
        begin, end = edges[::2], edges[1::2]
        longest = (end - begin + 2) // 3  # the longest period of a run whose windows these are
        longest[end - begin < 3] = 0
        at = np.flatnonzero(marked)
        near = back[at] <= np.repeat(longest, end - begin)
        if near.all():
            break
        marked[at[~near]] = False
    out: list[tuple[int, int]] = []
    for a, b, q in zip(begin.tolist(), end.tolist(), longest.tolist()):
        a, b = max(0, a - q - 1), min(n, b + 3)  # window k is of words k to k + 2
        while out and a <= out[-1][1]:
            a = min(a, out.pop()[0])
        out.append((a, b))
    return out


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Every run of a text's words, by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) == len(ids):
        return []
    return sorted(((a + s, n, p) for a, b in stretches(np.array(ids, np.int64)) for s, n, p in runs_in(ids[a:b])),
                  key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        depth[s + p] += 1
        depth[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def runs_column(text: Column) -> Column:
    """Struct of RUNS: words of each whole text, its runs by start then period, and its words
    joined by one space without those that runs repeat."""
    @arrow_udf(RUNS)
    def periodic(texts: pa.Array) -> pa.Array:
        n_words, found, kept = [], [], []
        for t in strings(texts):
            words = words_of(t)
            runs = find_runs(words)
            n_words.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            kept.append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass"))
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(found, pa.list_(run)),
                                           pa.array(kept, pa.string())], names=["n_words", "runs", "collapsed"])
    return periodic(text)


def with_runs(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column of RUNS; and its name."""
    (name,) = unused(docs, "periodic")
    return docs.withColumn(name, runs_column(F.col(text))), name


def longest_run(runs: Column) -> Column:
    """The run with the greatest length (ties: smallest start, then period) with its exponent in
    thousandths; null where there is none."""
    first = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -first["less"]
    return F.when(F.size(runs) > 0, F.struct(
        first["start"].alias("start"), length.alias("length"), first["period"].alias("period"),
        F.floor(length * 1000 / first["period"]).cast("long").alias("exponent_milli")))


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, for a tenth of the ids with the rest of the text from some word on replaced by
    repeats of its first words (the rule of the query ``op12_periodic_runs``)."""
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def repeated_tail_column(doc_id: Column, text: Column) -> Column:
    """Texts with ``repeated_tail`` applied; those that it leaves alone are handed on as they are."""
    @arrow_udf("string")
    def with_tail(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, t in zip(ids.to_pylist(), strings(texts)):
            words = words_of(t) if zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 else None
            out.append(t if words is None else b" ".join(repeated_tail(words, i)).decode("utf-8", "surrogatepass"))
        return pa.array(out, pa.string())
    return with_tail(doc_id, text)
