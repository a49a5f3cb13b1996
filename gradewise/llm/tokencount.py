"""Token counts by overlap resynchronisation.

A document longer than ``chunk_chars`` is encoded in chunks that overlap.  The tokens of
two neighbouring chunks are spliced at a boundary inside their overlap that both have and
that is *stable*: no entry of the vocabulary holds the two characters around it side by
side.  No merge can ever produce a symbol across such a place, so the encoder treats both
sides independently of each other, and the tokens before it (of the left chunk) and after
it (of the right chunk) are those of the whole text.  Where an overlap has no such place
it is doubled and the left chunk encoded again, up to the end of the document.

Cases: null and empty texts count 0; texts of any length count exactly as the library
counts the whole text; memory is bounded by the chunk except where a text has no stable
place at all; repeated rows count alike.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import strings, unused
from .vocabularies import piece_model

CHUNK_CHARS = 32768
OVERLAP_CHARS = 256
MARK = "▁"  # how the vocabulary writes a space
BATCH_CHARS = 1 << 18  # characters handed to the library at once


class PieceCounter:
    """Counts of one piece vocabulary with byte fallback."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        self.model = m = piece_model(path)
        self.chunk, self.overlap = chunk_chars, max(2, overlap_chars)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        #: characters that end with each token; the later bytes of a character add none
        self.chars = np.array([
            (0x80 <= int(p[3:5], 16) < 0xC0) ^ 1 if m.is_byte(i) else 0 if m.is_control(i) else len(p)
            for i, p in enumerate(pieces)], np.int64)
        #: neighbours that some entry holds side by side: a merge may cross them
        self.joined = {p[k:k + 2] for i, p in enumerate(pieces)
                       if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))
                       for k in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        pair = text[at - 1:at + 1].replace(" ", MARK)
        return pair not in self.joined

    def ends(self, text: str) -> np.ndarray:
        """For each token of ``text`` encoded alone, the characters that are complete after it.

        The encoder puts one mark before the text; it is taken off again.
        """
        return np.cumsum(self.chars[np.asarray(self.model.encode(text), np.int64)]) - 1

    def count_chunked(self, text: str) -> int:
        n, total = len(text), 0
        start = skip = 0  # characters of the chunk before ``skip`` are counted already
        while True:
            width = self.overlap
            while True:
                stop = min(start + self.chunk + width, n)
                left = self.ends(text[start:stop])
                if stop == n:
                    return total + int(left.size - np.searchsorted(left, skip, side="right") if skip else left.size)
                cut, right_start = self.boundary(text, left, start, stop - width, stop)
                if cut is not None:
                    break
                width *= 2  # nothing in this overlap is proven stable
            done = int(np.searchsorted(left, cut - start, side="right"))
            total += done - (int(np.searchsorted(left, skip, side="right")) if skip else 0)
            start, skip = right_start, cut - right_start

    def boundary(self, text, left, start, low, high):
        """A stable boundary in (low, high) that both chunks have, nearest the middle, and the
        start of the right chunk."""
        middle = (low + high) // 2
        near = sorted(range(low + 1, high), key=lambda p: abs(p - middle))
        right = None
        for at in near:
            if not self.stable(text, at):
                continue
            if right is None:
                right = self.ends(text[low:high])
            if has(left, at - start) and has(right, at - low):
                return at, low
        return None, None

    def counts(self, texts: list[str]) -> list[int]:
        out, batch, where, size = [0] * len(texts), [], [], 0
        def flush():
            for i, ids in zip(where, self.model.encode(batch, num_threads=1)):
                out[i] = len(ids)
            batch.clear(), where.clear()
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.count_chunked(t)
            elif t:
                batch.append(t), where.append(i)
                size += len(t)
                if size > BATCH_CHARS:
                    flush()
                    size = 0
        if batch:
            flush()
        return out


def has(ends: np.ndarray, value: int) -> bool:
    """Whether a token ends at ``value``."""
    k = int(np.searchsorted(ends, value))
    return k < ends.size and int(ends[k]) == value


@functools.lru_cache(maxsize=4)
def counter(path: str, chunk_chars: int, overlap_chars: int) -> PieceCounter:
    return PieceCounter(path, chunk_chars, overlap_chars)


def token_count(text: Column, path: str, chunk_chars: int = CHUNK_CHARS,
                overlap_chars: int = OVERLAP_CHARS) -> Column:
    """Tokens of each text, without begin, end or other added tokens."""
    @arrow_udf("long")
    def n_pieces(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path, chunk_chars, overlap_chars).counts(strings(texts)), pa.int64())
    return n_pieces(text)


def count_documents(docs: DataFrame, path: str, limit: int = 4096, text: str = "text",
                    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_tokens, over_limit; clashing names raise."""
    names = ["n_bytes", "n_tokens", "over_limit"]
    if unused(docs, *names) != names:
        raise ValueError(f"one of the columns {names} exists")
    return (docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("n_tokens", token_count(F.col(text), path, chunk_chars, overlap_chars))
            .withColumn("over_limit", F.col("n_tokens") > limit))
