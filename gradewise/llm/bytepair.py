"""Byte-pair encoding and decoding.

Encoding keeps the symbols of a piece in a doubly linked list and the mergeable
neighbours in a priority queue of (merge rank, position).  The lowest rank is merged
first, the leftmost of equal ranks before the others; an entry whose symbols have
changed since it was queued is stale and skipped.  Decoding concatenates the byte
strings of the vocabulary entries.

Cases: null and empty texts give no ids and the empty text; a text of any length is
encoded whole (memory grows with the longest piece only); repeated rows are encoded like
any other; ids that the vocabulary does not have raise ValueError on decoding.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import strings, unused, worker_cache, working_for
from .units import UNIT, Memo, special_pattern
from .vocabularies import library_tokenizer

#: Fixed value: the published splitting pattern of byte-level vocabularies.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[int, str]:
    """Printable stand-in of each byte: itself where it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class BytePairCodec:
    """Vocabulary, merge ranks and special strings of one byte-level vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.path = path
        shown = byte_alphabet()
        back = {c: b for b, c in shown.items()}
        self.byte_ids = [vocab[shown[b]] for b in range(256)]
        #: (left id, right id) -> (rank, merged id)
        self.ranks = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings: list[bytes | None] = [None] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        self.special = {}
        for t in spec["added_tokens"]:
            self.special[t["content"]] = t["id"]
            self.strings[t["id"]] = t["content"].encode()
        self.special_cut = special_pattern(self.special)
        self.memo = Memo(self._unit)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece: priority queue of merge ranks over a doubly linked symbol list."""
        n = len(data)
        symbol = [self.byte_ids[b] for b in data]
        if n < 2:
            return symbol
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks, queue = self.ranks, []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found:
                queue.append((found[0], i, symbol[i], symbol[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # stale: a neighbour was merged after this entry was queued
            symbol[i] = merged = ranks[left, right][1]
            symbol[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = ranks.get((merged, symbol[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, merged, symbol[k]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, symbol[h], merged))
        return [s for s in symbol if s >= 0]

    def _unit(self, unit: str) -> bytes:
        if unit.isascii():
            pieces = PIECES.findall(unit)
        else:  # the published splitter's Unicode tables may differ from ours beyond ASCII
            splitter = library_tokenizer(self.path).pre_tokenizer
            pieces = [unit[a:b] for _, (a, b) in splitter.pre_tokenize_str(unit)]
        ids = [i for p in pieces for i in self.merge(p.encode())]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as packed little-endian unsigned 32-bit integers."""
        look = self.memo.__getitem__
        if self.special_cut is None or not any(s in text for s in self.special):
            return b"".join(map(look, UNIT.findall(text)))
        out = []
        for k, part in enumerate(self.special_cut.split(text)):
            out.append(np.array([self.special[part]], "<u4").tobytes() if k % 2
                       else b"".join(map(look, UNIT.findall(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        if ids.size and int(ids.max()) >= len(self.strings):
            raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


@worker_cache
def codec(path: str) -> BytePairCodec:
    """One codec per worker process; its memory of units lives as long as the worker."""
    return BytePairCodec(path)


def encode_column(text: Column, path: str) -> Column:
    """Packed ids (BINARY, little-endian unsigned 32 bits) of a text column."""
    @arrow_udf("binary")
    def packed_ids(texts: pa.Array) -> pa.Array:
        working_for("byte pairs")
        c = codec(path)
        return pa.array([c.encode(t) for t in strings(texts)], pa.binary())
    return packed_ids(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of a packed id column (null ids: the empty text)."""
    @arrow_udf("string")
    def decoded_text(packed: pa.Array) -> pa.Array:
        working_for("byte pairs")
        c = codec(path)
        return pa.array([c.decode(p or b"") for p in packed.to_pylist()], pa.string())
    return decoded_text(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids",
                     n_tokens: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` and the packed ids and their number; existing columns of
    those names raise ValueError, so that nothing is overwritten."""
    if unused(docs, ids, n_tokens) != [ids, n_tokens]:
        raise ValueError(f"columns {ids}, {n_tokens} exist; name others")
    out = docs.withColumn(ids, encode_column(F.col(text), path))
    return out.withColumn(n_tokens, (F.octet_length(ids) / 4).cast("long"))


def decode_documents(docs: DataFrame, path: str, ids: str = "token_ids",
                     text: str = "decoded_text") -> DataFrame:
    if unused(docs, text) != [text]:
        raise ValueError(f"column {text} exists; name another")
    return docs.withColumn(text, decode_column(F.col(ids), path))
