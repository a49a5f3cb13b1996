"""Ranked lexical search with hashed max-sketches.

The score of a document for an item is the sum, over the item's terms with repeats, of the
term's weight times the document's impact for it: a whole number that grows with the term's
occurrences and shrinks with the document's length (``impacts``).

1. ``index_documents`` writes a row per document: its terms (64-bit hashes, sorted; a false
   match needs a collision) with their counts, and its sketch.  A sketch has ROWS rows of cells,
   four cells a row or more for each distinct term; in each row a hash puts every term into a
   cell, and the impacts that meet in a cell fold into their maximum, in steps of STEP rounded
   up.  The smallest of a term's cells bounds its impact in the document from above.
2. ``search`` looks up the terms of a whole batch of items at once; sums of weighted cells are
   upper bounds of the scores of a block of documents for all items.
3. Every task rescores, item by item, the documents of a block in order of falling bounds, with
   their exact counts, until the bound is below the item's k-th best exact score so far.  What a
   task hands on is k rows per item at most; the k best of all tasks are chosen in two steps.

Scores and bounds: no document is left out whose score could be among the k best, and equal
scores are decided by document id.  A batch of items has BATCH_TERMS different rows of terms or
so; more items take more passes over the index, so that what tasks get stays bounded.

Cases: null, empty and blank texts have no terms: such documents are never found, such items
find nothing; texts of any length count whole; repeated documents are ranked each (equal scores
and ids in any order), repeated items each get their ranks; null ids come last among equal
scores; an empty table of either kind gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import Spans
from .support import arrow_batches, byte_view, row_pieces, written

ROWS, CELLS = 2, 4
STEP = 4000
BLOCK_DOCS, RESCORE = 1000, 16
BATCH_TERMS = 100_000
SALTS = 64

#: Bytes that terms are made of: digits, ASCII letters and everything beyond ASCII.
IN_TERM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term (A-Z lowered), and the first term of each row with one end more."""
    if not data.size:
        return np.zeros(0, np.uint64), np.zeros(offsets.size, np.int64)
    inside = IN_TERM[data]
    edge_before, edge_after = np.ones(data.size, bool), np.ones(data.size, bool)
    edge_before[1:], edge_after[:-1] = ~inside[:-1], ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    edge_before[offsets[:-1][full]] = True
    edge_after[offsets[1:][full] - 1] = True
    begin = np.flatnonzero(inside & edge_before)
    end = np.flatnonzero(inside & edge_after) + 1
    return Spans(LOWER[data])(begin, end), np.searchsorted(begin, offsets)


def term_counts(column: pa.Array):
    """(first row, rows, terms, counts, row of each, terms of each row with repeats) of runs of rows;
    the distinct terms of a row are sorted."""
    for a, b in row_pieces(column):
        hashes, first = term_hashes(*byte_view(column.slice(a, b - a)))
        row = np.repeat(np.arange(b - a), np.diff(first))
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(hashes.size, bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield a, b - a, hashes[at], np.diff(np.append(at, hashes.size)), row[at], np.diff(first)


def term_lists(column: pa.Array) -> list[np.ndarray]:
    """Hashes of all terms of each row, in order."""
    out = []
    for a, b in row_pieces(column):
        hashes, first = term_hashes(*byte_view(column.slice(a, b - a)))
        out += np.split(hashes, first[1:-1])
    return out


def impacts(counts: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number impacts of terms that occur ``counts`` times in documents of ``length`` terms,
    of ``n_docs`` documents with ``n_terms`` terms."""
    m = 100 - 75 + (75 * length.astype(np.int64) * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * counts.astype(np.int64)) // (1000 * counts.astype(np.int64) + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def cells_of(terms: np.ndarray, width: np.ndarray | int) -> list[np.ndarray]:
    """Cell of each term in each row of a sketch whose rows have ``width`` (a power of two) cells."""
    mask = np.uint64(width - 1) if np.isscalar(width) else (width - 1).astype(np.uint64)
    return [((terms >> np.uint64(64 // ROWS * r)) & mask).astype(np.int64) for r in range(ROWS)]


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array of consecutive runs of ``values``."""
    ends = np.concatenate(([0], np.cumsum(sizes * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), sizes.size, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, and where those of each row begin, with one end more."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, kind, count=(ends[-1] - ends[0]) // size, offset=ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, kind)
    return values, (ends - ends[0]).astype(np.int64) // size


def sketches(terms: np.ndarray, values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all rows' sketches one after the other, and the number of cells of each row."""
    distinct = np.bincount(row, minlength=rows)
    width = 1 << np.ceil(np.log2(np.maximum(CELLS * distinct, 16))).astype(np.int64)
    begin = np.cumsum(ROWS * width) - ROWS * width
    cells = np.zeros(int((ROWS * width).sum()), np.uint8)
    steps = -(-values // STEP)
    for r, cell in enumerate(cells_of(terms, width[row])):
        np.maximum.at(cells, begin[row] + r * width[row] + cell, steps.astype(np.uint8))
    return cells, ROWS * width


INDEX = "doc_id long, n long, terms binary, counts binary, sketch binary"


def totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    def count(batches):
        for batch in batches:
            for a, b in row_pieces(batch.column(0)):
                _, first = term_begins(*byte_view(batch.column(0).slice(a, b - a)))
                n = np.diff(first)
                yield pa.RecordBatch.from_pydict({"docs": [int((n > 0).sum())], "terms": [int(n.sum())]})
    found = docs.select(text).mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def term_begins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of terms, and the first term of each row with one end more."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(offsets.size, np.int64)
    inside = IN_TERM[data]
    before = np.zeros(data.size, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[1:] > offsets[:-1]]] = False
    begin = np.flatnonzero(inside & ~before)
    return begin, np.searchsorted(begin, offsets)


def index_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """The written index of the documents that have a term, their number and that of all terms."""
    n_docs, n_terms = totals(docs, text)

    def index(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, rows, terms, counts, row, length in term_counts(batch.column(1)):
                distinct = np.bincount(row, minlength=rows)
                cells, n_cells = sketches(terms, impacts(counts, length[row], n_docs, n_terms), row, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, rows), pa.array(length.astype(np.int64)), packed(terms, distinct),
                     packed(counts.astype(np.uint32), distinct), packed(cells, n_cells)],
                    names=["doc_id", "n", "terms", "counts", "sketch"])

    with arrow_batches(docs.sparkSession, BLOCK_DOCS):
        found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(index, INDEX)
        return written(found.filter("n > 0"), "lexical-index"), n_docs, n_terms


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Documents that hold each of the sorted ``wanted`` terms."""
    def count(batches):
        sums = np.zeros(wanted.size, np.int64)
        for batch in batches:
            terms, _ = unpacked(batch.column(0), np.uint64)
            at = np.minimum(np.searchsorted(wanted, terms), wanted.size - 1)
            sums += np.bincount(at[wanted[at] == terms], minlength=wanted.size)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": found, "df": sums[found]})

    df = np.zeros(wanted.size, np.int64)
    # one row per wanted term at most
    for term, n in index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


class Items:
    """The terms of a batch of items with their weights."""

    def __init__(self, lists: list[np.ndarray], index: DataFrame, n_docs: int):
        self.terms = np.unique(np.concatenate(lists))
        df = document_frequencies(index, self.terms)
        weights = np.array([weight(int(d), n_docs) if d else 0 for d in df], np.int64)
        self.of = []  # sorted terms of each item and what an impact of 1 is worth
        self.factors = np.zeros((self.terms.size, len(lists)), np.float32)
        for k, terms in enumerate(lists):
            at = np.searchsorted(self.terms, terms)
            distinct, repeats = np.unique(at, return_counts=True)
            worth = weights[distinct] * repeats
            self.of.append((self.terms[distinct[worth > 0]], worth[worth > 0]))
            # a little more, so that rounding in single precision keeps the sums upper bounds
            self.factors[distinct, k] = worth * (STEP * (1 + 1e-5))

    def bounds(self, cells: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, a row per document."""
        size = np.diff(begin)
        out = np.empty((size.size, self.factors.shape[1]), np.float32)
        for n in np.unique(size).tolist():
            width = n // ROWS
            for rows in np.array_split(np.flatnonzero(size == n), -(-int((size == n).sum()) // 256)):
                block = np.stack([cells[begin[r]:begin[r + 1]] for r in rows]).reshape(rows.size, ROWS, width)
                least = None
                for r, cell in enumerate(cells_of(self.terms, width)):
                    found = block[:, r, :].take(cell, axis=1)
                    least = found if least is None else np.minimum(least, found)
                out[rows] = least.astype(np.float32) @ self.factors
        return out


class Best:
    """The k highest (score, smallest id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, score: int, doc_id: int | None, arrival: int) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0), -arrival)  # the worst one is the heap's first
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    @property
    def least(self) -> int:
        """A document needs this score at least."""
        return self.heap[0][0] if len(self.heap) == self.k else 1


def exact_scores(item: tuple[np.ndarray, np.ndarray], rows: np.ndarray, terms, counts, begin, length, n_docs: int, n_terms: int) -> list[int]:
    """Exact scores of some documents for one item."""
    wanted, worth = item
    out = []
    for r in rows.tolist():
        own = terms[begin[r]:begin[r + 1]]
        at = np.minimum(np.searchsorted(own, wanted), own.size - 1)
        hit = np.flatnonzero(own[at] == wanted)
        tf = counts[begin[r]:begin[r + 1]][at[hit]]
        out.append(int((worth[hit] * impacts(tf, length[r:r + 1], n_docs, n_terms)).sum()))
    return out


def search_batch(index: DataFrame, items: Items, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every task for each item."""
    def search(batches):
        best, arrival = [Best(k) for _ in items.of], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            length = batch.column("n").to_numpy()
            terms, begin = unpacked(batch.column("terms"), np.uint64)
            counts, _ = unpacked(batch.column("counts"), np.uint32)
            bounds = items.bounds(*unpacked(batch.column("sketch"), np.uint8))
            for j, (item, own) in enumerate(zip(items.of, best)):
                bound = bounds[:, j]
                open_ = np.flatnonzero(bound >= own.least)
                open_ = open_[np.argsort(-bound[open_], kind="stable")]
                for a in range(0, open_.size, RESCORE):
                    part = open_[a:a + RESCORE]
                    part = part[bound[part] >= own.least]
                    if not part.size:
                        break  # bounds fall: none of the rest can be among the best
                    for r, score in zip(part.tolist(), exact_scores(item, part, terms, counts, begin, length, n_docs, n_terms)):
                        if score >= own.least:
                            own.add(score, ids[r], arrival + r)
            arrival += len(ids)
        rows = [(j, -i if known else None, score) for j, own in enumerate(best) for score, known, i, _ in own.heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return index.mapInArrow(search, "item long, doc_id long, score long")


def first_of(found: DataFrame, k: int, *by) -> DataFrame:
    """The k best rows of each item and salt (or of each item), numbered from 1."""
    order = W.partitionBy("item", *by).orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents with the highest scores above 0 for
    every item."""
    spark = docs.sparkSession
    index, n_docs, n_terms = index_documents(docs, doc_id, text)
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    # a word has a byte and a blank at least, so bytes / 2 bounds an item's terms
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // (2 * BATCH_TERMS)))
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(batches))
    out = []
    for b in range(batches):
        rows = asked.filter(part == b).toArrow()
        lists = term_lists(rows.column("text").combine_chunks()) if rows.num_rows else []
        if not sum(map(len, lists)) or not n_docs:
            continue
        with arrow_batches(spark, BLOCK_DOCS):
            found = search_batch(index, Items(lists, index, n_docs), k, n_docs, n_terms)
            salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
            found = written(first_of(first_of(salted, k, "salt").drop("rank", "salt"), k), "lexical-found")
        names = spark.createDataFrame(pa.table({"item": pa.array(range(rows.num_rows), pa.int64()), "item_id": rows.column("item_id")}))
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        nothing = {"rank": "int", "doc_id": "long", "score": "long"}
        return asked.limit(0).select("item_id", *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()])
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    return found
