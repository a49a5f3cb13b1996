"""Near-duplicate documents by an n-gram Jaccard join with rare-first prefix filtering.

A document is the set of its distinct word shingles (64-bit hashes; a false match of two
sets needs a hash collision, about n**2 / 2**65 for n hashes compared).  Documents with
equal sets are one *class*.  Two classes link when their Jaccard similarity is at least
``num / den``; the result gives each document the smallest document id it can reach and the
number of documents that it links with, and ``link_pairs`` gives the pairs of classes.

1. Document frequencies of all shingles are counted into 2**SKETCH_BITS counters (a table of
   fixed size, summed over all documents), whose logarithms define the order rare first,
   ties by hash.  Any order gives the same links; rare ones first gives few candidates.
2. Each class is indexed under its prefix, its first n - ceil(t n) + 1 shingles: classes
   that link share one.  Prefix shingles of one class alone are dropped.
3. Candidates share a prefix shingle and pass the length filter and the positional filter
   (what can still be shared after the places of the common shingle).  The suffix filter
   then bounds the Hamming distance of the two sets from their counts in RANGES ranges of
   the hash space.  What is left is verified once per pair on the whole sets.
4. A prefix shingle may have very many classes (a group of near copies), so candidates are
   not all pairs of its classes.  In a round each shingle compares its most central class
   with the others; links join components (alternating star contraction), and the next
   round drops shingles whose classes are all connected.  When few pairs of classes in
   different components are left, or a round did not halve them (what is left is unlike and
   does not grow together), one join compares all that pass the filters.  A pair is left
   out only if both are in one component already, so components are exact.
5. Links join classes of one component only, so all of them are found by comparing the
   classes of each component: every pair once, on the whole sets.  A component is dealt into
   blocks and each pair of blocks is a group of its own (``linked_in_blocks``), so a group of
   near copies is many groups of bounded size.  ``count_links`` False leaves this step out.

Hot shingles: counts and centres are partial aggregates, joins back are plain sort-merge
joins that Spark splits; no group is collected anywhere.

Cases: null, empty and blank texts have no shingles and link with nothing; fewer words than
a shingle are one shingle; null ids never are the smallest; rows with equal ids are
documents of their own; an empty table gives an empty result; texts count whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .hashing import Spans, mixed
from .support import arrow_batches, byte_view, release, row_pieces, unused, working_for, written

PIECE_BYTES = 1 << 18  # of text whose shingles are hashed at once
SKETCH_BITS = 23
SKETCH_BLOCKS = 64
RANGES = 64
MAX_ROUNDS = 12
GRAM_BITS, CLASS_BITS = 26, 23  # flags of shared shingles and of wanted classes: 8 MB and 1 MB

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
STEPS = np.array([0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                  0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0x8CB92BA72F3D8DD7, 0x589965CC75374CC3], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lowered), and the first word of each row with one end more."""
    if not data.size:
        return np.zeros(0, np.uint64), np.zeros(offsets.size, np.int64)
    blank = BLANK[data]
    edge_before, edge_after = np.empty(data.size, bool), np.empty(data.size, bool)
    edge_before[1:], edge_after[:-1] = blank[:-1], blank[1:]
    full = offsets[1:] > offsets[:-1]
    edge_before[offsets[:-1][full]] = True
    edge_after[offsets[1:][full] - 1] = True
    begin = np.flatnonzero(~blank & edge_before)
    end = np.flatnonzero(~blank & edge_after) + 1
    return Spans(LOWER[data])(begin, end), np.searchsorted(begin, offsets)


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each row."""
    working_for("shingles")
    for a, b in row_pieces(column, PIECE_BYTES):
        words, first = word_hashes(*byte_view(column.slice(a, b - a)))
        windows = np.zeros(max(words.size - size + 1, 0), np.uint64)
        for k in range(size):
            windows += words[k:k + windows.size] * STEPS[k]
        windows = mixed(windows)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= size:
                yield np.unique(windows[lo:hi - size + 1])
            elif hi > lo:
                short = (words[lo:hi] * STEPS[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield mixed(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int | None:
    """Identifier of a set; equal sets have equal ones."""
    if not shingles.size:
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequency_sketch(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """A byte per counter: 8 times the logarithm of the documents counted there, over all
    documents; 2**SKETCH_BITS bytes whatever their number."""
    per_block = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def count(batches):
        sums, docs_in = np.zeros(1 << SKETCH_BITS, np.uint16), 0

        def packed():
            # mostly small numbers: packed, a task's counts take a few megabytes
            blocks = [pa.compress(b.tobytes(), "zstd", asbytes=True) for b in sums.reshape(SKETCH_BLOCKS, per_block)]
            return pa.RecordBatch.from_pydict({"block": np.arange(SKETCH_BLOCKS), "counts": blocks})
        for batch in batches:
            for s in shingle_sets(batch.column(0), size):
                sums[counter_of(s)] += 1  # once per document
                docs_in += 1
                if docs_in == 0xFFFF:  # no counter can be larger
                    yield packed()
                    sums[:], docs_in = 0, 0
        yield packed()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(pa.decompress(counts, per_block * 2, "zstd", asbytes=True), np.uint16)
                sums[block] = sums.get(block, 0) + part.astype(np.int64)
        logs = [np.minimum(8 * np.log2(s + 1.0), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(logs, pa.binary())], names=["block", "counts"])

    kind = "block long, counts binary"
    summed = docs.select(text).mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).collect()
    sketch = np.zeros((SKETCH_BLOCKS, per_block), np.uint8)
    for block, counts in summed:
        sketch[block] = np.frombuffer(counts, np.uint8)
    return sketch.reshape(-1)


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_size(n: int, num: int, den: int) -> int:
    return n + num * -n // den + 1  # n - ceil(n num / den) + 1


SUMMARY = "id long, n int, centre float, ranges binary, prefix array<long>"


def summary_column(text: Column, sketch: np.ndarray, size: int, num: int, den: int) -> Column:
    """Struct of SUMMARY; id is null for empty sets.

    ``centre`` is the mean logarithm of its shingles' document frequencies, ``ranges`` its counts in RANGES
    equal parts of the hash space, ``prefix`` its rarest shingles in order.
    """
    @arrow_udf(SUMMARY)
    def summary(texts: pa.Array) -> pa.Array:
        rows = {"id": [], "n": [], "centre": [], "ranges": [], "prefix": []}
        for s in shingle_sets(texts, size):
            frequency = sketch[counter_of(s)]
            p = prefix_size(s.size, num, den) if s.size else 0
            order = np.lexsort((s, frequency))[:p]
            rows["id"].append(set_id(s))
            rows["n"].append(s.size)
            rows["centre"].append(float(frequency.mean()) if s.size else 0.0)
            parts = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES)
            rows["ranges"].append(np.minimum(parts, 0xFFFF).astype("<u2").tobytes())
            rows["prefix"].append(s[order].view(np.int64))
        kinds = [pa.int64(), pa.int32(), pa.float32(), pa.binary(), pa.list_(pa.int64())]
        return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))
    return summary(text)


def class_column(text: Column, size: int) -> Column:
    """Struct of id (null for empty sets) and n of each text's set."""
    @arrow_udf("id long, n int")
    def class_of(texts: pa.Array) -> pa.Array:
        found = [(set_id(s), s.size) for s in shingle_sets(texts, size)]
        columns = list(zip(*found)) or [(), ()]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())], names=["id", "n"])
    return class_of(text)


def enough(shared, n_a, n_b, num: int, den: int):
    """Whether ``shared`` common shingles make two sets of these sizes link."""
    return den * shared >= num * (n_a + n_b - shared)


def possible(num: int, den: int, a: str, b: str) -> Column:
    """Length and positional filters of two index entries of one shingle."""
    n_a, n_b = F.col(f"{a}n").cast("long"), F.col(f"{b}n").cast("long")
    rest = F.least(n_a - F.col(f"{a}pos"), n_b - F.col(f"{b}pos"))
    return (den * n_a >= num * n_b) & (den * n_b >= num * n_a) & enough(rest, n_a, n_b, num, den)


def components(edges: DataFrame) -> DataFrame:
    """(hi, lo): every vertex that is not the smallest of its component with the smallest one.

    Alternating large-star and small-star contraction; each pass is a partial aggregate and a
    join, written to the shared folder.
    """
    current = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                      .filter("hi <> lo"), "links")
    while True:
        # done when no vertex is both above one and below another
        if current.select(F.col("lo").alias("v")).join(current.select(F.col("hi").alias("v")), "v", "left_semi").isEmpty():
            lows = current.groupBy("hi").agg(F.min("lo").alias("lo"), F.max("lo").alias("other"))
            if lows.filter("lo <> other").isEmpty():
                return current
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(lowest, "hi")
                 .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                 .select("e.hi", "e.lo").filter("hi <> lo").distinct())
        current = written(small, "links")


def bit_table(values: DataFrame, bits: int) -> np.ndarray:
    """2**bits flags: true where a value of the (long, evenly spread) column has these leading
    bits.  Words are put together by the cluster; the driver gets 2**bits / 8 bytes at most
    twice over, whatever the number of values."""
    value = F.col(values.columns[0])
    bit = F.shiftrightunsigned(value, 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = (values.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(one).alias("flags"))).toArrow()
    table = np.zeros(1 << bits >> 6, np.int64)
    table[words.column("word").to_numpy()] = words.column("flags").to_numpy()
    return table


def flagged(table: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit values have their flag set."""
    bit = (values >> np.uint64(64 - bits)).astype(np.int64)
    return (table[bit >> 6] >> (bit & 63)) & 1 == 1


class Verifier:
    """Links among candidate pairs (a, b)."""

    def __init__(self, classes: DataFrame, docs: DataFrame, text: str, size: int, num: int, den: int):
        self.classes, self.docs, self.text = classes, docs, text
        self.size, self.num, self.den = size, num, den

    def __call__(self, pairs: DataFrame) -> DataFrame:
        num, den = self.num, self.den

        @arrow_udf("boolean")
        def suffix_filter(x: pa.Array, y: pa.Array, n_x: pa.Array, n_y: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.bool_())
            a, b = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, RANGES).astype(np.int64) for c in (x, y))
            n_a, n_b = (n.to_numpy().astype(np.int64) for n in (n_x, n_y))
            return pa.array(enough((n_a + n_b - np.abs(a - b).sum(1)) // 2, n_a, n_b, num, den))

        @arrow_udf("boolean")
        def verified(x: pa.Array, y: pa.Array) -> pa.Array:
            out = []
            for a, b in zip(x, y):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                out.append(bool(enough(np.intersect1d(s, t, assume_unique=True).size, s.size, t.size, num, den)))
            return pa.array(out, pa.bool_())

        def sides(frame, *columns):
            return [frame.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab"]
        of_a, of_b = sides(self.classes, "ranges", "n")
        left = (pairs.join(of_a, "a").join(of_b, "b").filter(suffix_filter("ranges_a", "ranges_b", "n_a", "n_b")).select("a", "b"))
        left = written(left, "candidate-pairs")
        release(left.sparkSession)
        ids = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id")))
        of_a, of_b = sides(needed_sets(self.docs, self.text, ids, self.size), "shingles")
        return left.join(of_a, "a").join(of_b, "b").filter(verified("shingles_a", "shingles_b")).select("a", "b")


def needed_sets(docs: DataFrame, text: str, ids: DataFrame, size: int) -> DataFrame:
    """Written (id, shingles) of the classes in ``ids``, and of a few more.

    Sets are computed from the texts again instead of being kept for all documents; a flag
    table of fixed size stops nearly all that are not wanted before the shuffle, and the
    others find no pair.
    """
    wanted = bit_table(ids, CLASS_BITS)

    def sets(batches):
        done = set()
        for batch in batches:
            rows, held = [], 0
            for s in shingle_sets(batch.column(0), size):
                i = set_id(s)
                if i is None or i in done or not flagged(wanted, CLASS_BITS, np.array([i & (1 << 64) - 1], np.uint64))[0]:
                    continue
                done.add(i)
                rows.append((i, s.tobytes()))
                held += s.nbytes
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["id", "shingles"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["id", "shingles"])

    found = docs.select(text).mapInArrow(sets, "id long, shingles binary")
    return written(found.dropDuplicates(["id"]), "shingle-sets")


def index_entries(classes: DataFrame, shared: np.ndarray) -> DataFrame:
    """(gram, id, n, pos, centre) of the prefix shingles whose flag is set: nearly all that only
    one class has stop here, before the shuffle."""
    def entries(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = prefix.value_lengths().to_numpy()
            grams = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(len(prefix)), sizes)
            pos = np.arange(grams.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = flagged(shared, GRAM_BITS, grams.view(np.uint64))
            row = row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[keep]), batch.column("id").take(pa.array(row)), batch.column("n").take(pa.array(row)),
                 pa.array(pos[keep].astype(np.int32)), batch.column("centre").take(pa.array(row))],
                names=["gram", "id", "n", "pos", "centre"])

    return classes.select("id", "n", "centre", "prefix").mapInArrow(entries, "gram long, id long, n int, pos int, centre float")


def linked_classes(classes: DataFrame, docs: DataFrame, text: str, size: int, num: int, den: int) -> DataFrame:
    """(hi, lo) of ``components`` over all links between classes."""
    grams = classes.select(F.explode("prefix").alias("gram"))
    shared = written(grams.groupBy("gram").count().filter("count > 1").select("gram"), "shared-shingles")
    release(shared.sparkSession)
    index = written(index_entries(classes, bit_table(shared, GRAM_BITS)).join(shared, "gram"), "prefix-index")
    release(index.sparkSession)
    verify = Verifier(classes, docs, text, size, num, den)
    found, before = None, math.inf  # star edges of the components so far; pairs left before the round
    for _ in range(MAX_ROUNDS):
        centre = index.groupBy("gram").agg(*[F.max_by(c, F.struct("centre", "id")).alias(f"centre_{c}") for c in ("id", "n", "pos")])
        tried = index.join(centre, "gram").filter("id <> centre_id").filter(possible(num, den, "", "centre_"))
        if found is not None:
            tried = tried.join(centre_roots(centre, found), "gram").filter("root <> centre_root")
        pairs = tried.select(F.col("id").alias("a"), F.col("centre_id").alias("b"))
        found = join_links(found, verify(once(pairs)))
        # left: shingles with two or more classes besides the centre, not all in one component
        rest = index.join(centre.select("gram", "centre_id"), "gram").filter("id <> centre_id").drop("centre_id", "root")
        rest = rooted(rest, found)
        per_root = rest.groupBy("gram", "root").agg(F.count("*").cast("double").alias("c"))
        per_gram = per_root.groupBy("gram").agg(((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2).alias("open_pairs"),
                                                F.sum("c").alias("open_entries"))
        open_ = written(per_gram.filter("open_pairs > 0"), "open-shingles")
        left, entries_left = open_.agg(F.coalesce(F.sum("open_pairs"), F.lit(0.0)), F.coalesce(F.sum("open_entries"), F.lit(0.0))).first()
        if left == 0:
            return found
        index = written(rest.join(open_.select("gram"), "gram"), "prefix-index")
        if left <= 4 * entries_left or left > before / 2:
            break
        before = left
    other = index.select("gram", *[F.col(c).alias(f"other_{c}") for c in ("id", "n", "pos", "root")])
    pairs = (index.join(other, "gram").filter("id < other_id and root <> other_root").filter(possible(num, den, "", "other_"))
             .select(F.col("id").alias("a"), F.col("other_id").alias("b")))
    return join_links(found, verify(once(pairs)))


def once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, with the side ``b`` that it was seen with last by number."""
    return (pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("b").alias("b"))
            .select(F.when(F.col("b") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("a"), "b"))


def join_links(found: DataFrame | None, links: DataFrame) -> DataFrame:
    if found is not None:
        links = links.unionByName(found.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    return components(links)


def rooted(frame: DataFrame, found: DataFrame) -> DataFrame:
    return (frame.join(found.select(F.col("hi").alias("id"), F.col("lo").alias("__root")), "id", "left")
            .withColumn("root", F.coalesce("__root", "id")).drop("__root"))


def centre_roots(centre: DataFrame, found: DataFrame) -> DataFrame:
    return rooted(centre.select("gram", F.col("centre_id").alias("id")), found).select("gram", F.col("root").alias("centre_root"))


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of common values of each set of ``x`` with each of ``y``.

    Values that many pairs share are counted by a matrix product, the others pair by pair.
    """
    nx, ny = len(x), len(y)
    values, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row_x, row_y = (np.repeat(np.arange(len(side)), [s.size for s in side]) for side in (x, y))
    at_x, at_y = place[:row_x.size], place[row_x.size:]
    in_x, in_y = (np.bincount(at, minlength=values.size) for at in (at_x, at_y))
    both = in_x * in_y
    heavy, light = 200 * both >= nx * ny, (both > 0) & (200 * both < nx * ny)
    total = np.zeros((nx, ny), np.int64)
    many, step = np.flatnonzero(heavy & (both > 0)), max((1 << 22) // (nx + ny), 1)
    column = np.full(values.size, -1)
    for k in range(0, many.size, step):
        part = many[k:k + step]
        column[part] = np.arange(part.size)
        sides = []
        for n, row, at in ((nx, row_x, at_x), (ny, row_y, at_y)):
            matrix, known = np.zeros((n, part.size), np.float32), column[at] >= 0
            matrix[row[known], column[at[known]]] = 1
            sides.append(matrix)
        total += (sides[0] @ sides[1].T).astype(np.int64)  # whole numbers up to 2**22: exact
        column[part] = -1
    if light.any():
        order = np.argsort(at_y, kind="stable")
        begin = np.cumsum(in_y) - in_y
        row, at = row_x[light[at_x]], at_x[light[at_x]]
        ends = np.cumsum(in_y[at])
        a = 0
        while a < at.size:  # a bounded number of pairs at a time
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 22), side="right")), a + 1)
            size = in_y[at[a:b]]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            other = row_y[order[np.repeat(begin[at[a:b]], size) + within]]
            total += np.bincount(np.repeat(row[a:b], size) * ny + other, minlength=nx * ny).reshape(nx, ny)
            a = b
    return total


def linked_in_blocks(dealt: DataFrame, num: int, den: int, pairs: bool) -> DataFrame:
    """Links among the classes of each (root, lo, hi): between the blocks lo and hi, or inside
    the block.  (a, b) of each link, or (id, classes, docs) with the classes and documents that
    a class links with there."""
    names = ["a", "b"] if pairs else ["id", "classes", "docs"]

    def links(group: list[pa.RecordBatch]) -> list[np.ndarray]:
        table = pa.Table.from_batches(group)
        if table.num_rows < 2:
            return [np.zeros(0, np.int64) for _ in names]
        ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
        sets = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
        sizes = np.array([s.size for s in sets])
        x = np.flatnonzero(block == table.column("lo")[0].as_py())
        y = np.flatnonzero(block == table.column("hi")[0].as_py())
        if not (x.size and y.size):
            return [np.zeros(0, np.int64) for _ in names]
        shared = shared_counts([sets[k] for k in x], [sets[k] for k in y])
        linked = enough(shared, sizes[x][:, None], sizes[y][None, :], num, den)
        if table.column("lo")[0] == table.column("hi")[0]:
            linked = np.triu(linked, 1)
        if pairs:
            i, j = np.nonzero(linked)
            return [np.minimum(ids[x[i]], ids[y[j]]), np.maximum(ids[x[i]], ids[y[j]])]
        return [np.concatenate([ids[x], ids[y]]), np.concatenate([linked.sum(1), linked.sum(0)]),
                np.concatenate([linked @ copies[y], copies[x] @ linked])]

    def compare(batches):
        key, group, out, held = None, [], [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=names)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("root", "lo", "hi")], 1).astype(np.int64)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if group and key != tuple(keys[a]):
                    out.append(links(group))
                    held += out[-1][0].size + 1
                    group = []
                    if held > 1 << 16:
                        yield packed()
                        out, held = [], 0
                key = tuple(keys[a])
                group.append(batch.slice(a, b - a))
        if group:
            out.append(links(group))
        if out:
            yield packed()

    return dealt.mapInArrow(compare, ", ".join(f"{n} long" for n in names))


def dealt_classes(per_class: DataFrame, docs: DataFrame, text: str, size: int) -> DataFrame:
    """The classes of components of two or more with their sets, once for each pair of blocks
    (lo, hi) of the component that their block is in."""
    per_root = per_class.groupBy("root").agg(F.count("*").alias("k"), F.sum(F.col("n").cast("long")).alias("total"))
    # a block has 3 sqrt(k) classes or so, and about 8 MB of shingles
    blocks = F.greatest(F.ceil(F.sqrt("k") / 3), F.ceil(F.col("total") * 8 / (8 << 20))).cast("int")
    several = per_root.filter("k > 1").select(F.col("root").alias("root_"), F.when((F.col("k") <= 64) & (F.col("total") < 1 << 20), 1)
                                              .otherwise(F.least(blocks, F.col("k").cast("int"))).alias("blocks"))
    linked = written(per_class.join(several, F.col("root") == F.col("root_")).select("id", "root", "copies", "blocks"), "linked-classes")
    sets = needed_sets(docs, text, linked.select("id"), size)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return (linked.join(sets, "id").withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "copies", "shingles")
            .repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi"))


def checked(docs: DataFrame, doc_id: str, text: str, size: int, num: int, den: int) -> DataFrame:
    if not 0 < num <= den or not 0 < size <= STEPS.size:
        raise ValueError("the similarity must be in (0, 1], a shingle 1 to 8 words")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85,
                    den: int = 100, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, class_id (null for empty sets) and component_id of every document; with
    ``count_links`` also the numbers of other documents (n_links) and other classes
    (n_class_links) that it links with."""
    rows = checked(docs, doc_id, text, size, num, den)
    with arrow_batches(docs.sparkSession, 1000):
        members, per_class = _classes_of(rows, size, num, den)
        smallest = per_class.groupBy(F.col("root").alias("root_")).agg(F.min("least").alias("smallest"))
        known = per_class.join(smallest, F.col("root") == F.col("root_")).select(F.col("id").alias("id_"), "smallest", "copies")
        counts = []
        if count_links:
            found = linked_in_blocks(dealt_classes(per_class, rows, "text", size), num, den, False)
            found = written(found.groupBy("id").agg(F.sum("classes").alias("classes"), F.sum("docs").alias("docs")), "link-counts")
            known = known.join(found, F.col("id_") == F.col("id"), "left").drop("id")
            counts = [F.coalesce(F.col("docs"), F.lit(0)) + F.col("copies") - 1, F.coalesce(F.col("classes"), F.lit(0))]
            counts = [F.when(F.col("id").isNull(), 0).otherwise(c).cast("long").alias(n) for n, c in zip(("n_links", "n_class_links"), counts)]
    return members.join(known, F.col("id") == F.col("id_"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("class_id"),
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"), *counts)


def link_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85,
               den: int = 100) -> DataFrame:
    """(a, b), a < b: the class ids of every link between different classes, each once; the
    class ids of documents are those of ``near_duplicates``."""
    rows = checked(docs, doc_id, text, size, num, den)
    with arrow_batches(docs.sparkSession, 1000):
        _, per_class = _classes_of(rows, size, num, den)
        return written(linked_in_blocks(dealt_classes(per_class, rows, "text", size), num, den, True), "link-pairs")


def _classes_of(rows: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Written (doc_id, id, n) of the documents, and (id, n, copies, least, root) of the classes."""
    sketch = frequency_sketch(rows, "text", size)
    summary = rows.select(summary_column(F.col("text"), sketch, size, num, den).alias("s")).select("s.*")
    # texts of one id have one summary: any stands for the class
    classes = written(summary.filter("id is not null").dropDuplicates(["id"]), "shingle-classes")
    release(classes.sparkSession)
    stars = linked_classes(classes, rows, "text", size, num, den)
    # which document is in which class: hashed again rather than kept with all prefixes till here
    members = written(rows.select("doc_id", class_column(F.col("text"), size).alias("c")).select("doc_id", "c.*"), "class-members")
    per_class = (members.filter("id is not null").groupBy("id")
                 .agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    return members, written(rooted(per_class, stars), "rooted-classes")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, with their columns: of each component the one with the smallest
    id (the smallest class id among equal ones), and every document without shingles.  Of repeated rows (equal id and set) one stays."""
    kept, place, stays, least = unused(docs, "class_of_text", "place_in_class", "staying_class", "smallest_id")
    options = {"size": 4, "num": 85, "den": 100} | options
    rows = checked(docs, doc_id, text, **options)
    with arrow_batches(docs.sparkSession, 1000):
        _, per_class = _classes_of(rows, **options)
    # of classes with the same smallest document id the one with the smallest class id
    first = F.min(F.struct(F.col("least").isNull().alias("no_id"), F.col("least"), F.col("id"))).alias("first")
    stay = per_class.groupBy("root").agg(first).select(F.col("first.id").alias(stays), F.col("first.least").alias(least))

    tagged = docs.withColumn(kept, class_column(F.col(text), options["size"])["id"])
    same = F.col(doc_id).eqNullSafe(F.col(least)) & (F.col(kept) == F.col(stays))
    joined = tagged.join(stay, same, "left").filter(F.col(kept).isNull() | F.col(stays).isNotNull())
    in_class = W.partitionBy(doc_id, kept).orderBy(F.lit(0))
    joined = joined.withColumn(place, F.row_number().over(in_class))
    return joined.filter(F.col(kept).isNull() | (F.col(place) == 1)).select(*docs.columns)
