"""Token ids in Arrow IPC files of equal-length sequences.

Documents are encoded, ended with an id each, put in ascending doc_id order and written as
shards.  A shard is one range of doc_id and has two Arrow files: ``NAME.arrow`` holds
record batches of two fixed-size-list columns, ``ids`` and ``mask`` (true where a sequence
has an id, false in the padding of the shard's last sequence), and ``NAME.docs.arrow``
holds doc_id, start (within the shard) and n_tokens of each document.  Ids are 16-bit where
the vocabulary allows it.  Files are memory-mapped, so any sequence or document is a view
of the file's bytes.

A task writes its shard under a name of its own attempt, and the written manifest lists the
shards of the attempts that Spark accepted, in order; files of lost or repeated attempts
are never listed.  Memory is bounded by one record batch and the longest document.

Cases: null and empty texts give the end id alone; null ids sort first; documents with
equal ids are ordered by text; texts of any length are written whole, over as many sequences
as they need; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .support import fresh_folder, local_path, strings, written
from .units import UNIT, Memo
from .vocabularies import library_tokenizer

SEQUENCE = 2048
BATCH_SEQUENCES = 256
ONE_RUN = re.compile(r" ?[A-Za-z]+")

MANIFEST = "part long, path string, n_docs long, n_tokens long, n_sequences long"


class LibraryEncoder:
    """The tokenizers library, asked once per unit of text (see ``units``)."""

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = Memo(self._unit)

    def _unit(self, unit: str) -> bytes:
        if ONE_RUN.fullmatch(unit):  # one piece of the splitter: straight to the merges
            ids = [t.id for t in self.tokenizer.model.tokenize(unit.replace(" ", "Ġ"))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, UNIT.findall(text))), self.kind)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class ShardWriter:
    """Writes one shard; documents come in order."""

    def __init__(self, folder: str, id_type: pa.DataType, kind: np.dtype, sequence: int, pad: int = 0):
        self.system, root = local_path(folder)
        self.system.create_dir(root, recursive=True)
        self.name = uuid.uuid4().hex
        self.path = f"{folder}/{self.name}"
        self.sequence, self.kind, self.pad = sequence, kind, pad
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)),
                                 ("mask", pa.list_(pa.bool_(), sequence))])
        self.docs_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.system.open_output_stream(f"{root}/{self.name}{end}") for end in (".arrow", ".docs.arrow")]
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs_out = pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.waiting, self.n_waiting, self.docs = [], 0, []
        self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_tokens, ids.size))
        self.n_tokens += ids.size
        self.n_docs += 1
        self.waiting.append(ids)
        self.n_waiting += ids.size
        if self.n_waiting >= self.sequence * BATCH_SEQUENCES:
            self._flush(self.n_waiting // self.sequence)
        if len(self.docs) >= 1 << 16:
            self._flush_docs()

    def _flush(self, sequences: int, real: int | None = None) -> None:
        data = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        size = sequences * self.sequence
        now, rest = data[:size], data[size:]
        mask = np.ones(size, bool)
        mask[now.size:] = False
        now = np.concatenate((now, np.full(size - now.size, self.pad, self.kind)))
        for a in range(0, size, self.sequence * BATCH_SEQUENCES):
            b = min(a + self.sequence * BATCH_SEQUENCES, size)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[a:b]), self.sequence) for x in (now, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.n_sequences += sequences
        self.waiting, self.n_waiting = [rest], rest.size

    def _flush_docs(self) -> None:
        columns = [pa.array(c, t.type) for c, t in zip(zip(*self.docs), self.docs_schema)]
        self.docs_out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.docs_schema))
        self.docs = []

    def close(self) -> None:
        if self.n_waiting:
            self._flush(-(-self.n_waiting // self.sequence))
        if self.docs:
            self._flush_docs()
        for x in (self.out, self.docs_out, *self.sinks):
            x.close()


class Shard:
    """Random access to a written shard."""

    def __init__(self, path: str):
        system, root = local_path(path)
        local = system.type_name == "local"

        def opened(name):
            return pa.ipc.open_file(pa.memory_map(name) if local else system.open_input_file(name))
        self.data, self.index = opened(f"{root}.arrow"), opened(f"{root}.docs.arrow")
        self.sequence = self.data.schema.field("ids").type.list_size
        self._at, self._batch = None, None
        # every batch but the last has the rows of the first, or the ends are added up
        rows = [self.data.get_batch(k).num_rows for k in range(self.data.num_record_batches)]
        self.ends = np.cumsum([0, *rows]) * self.sequence

    def _values(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if self._at != k:
            batch = self.data.get_batch(k)
            self._batch = (batch.column("ids").flatten().to_numpy(zero_copy_only=True), batch.column("mask").flatten())
            self._at = k
        return self._batch

    def sequence_at(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``: views of the mapped file."""
        k = int(np.searchsorted(self.ends, i * self.sequence, side="right")) - 1
        a = i * self.sequence - int(self.ends[k])
        ids, mask = self._values(k)
        return ids[a:a + self.sequence], mask.slice(a, self.sequence)

    def tokens(self, start: int, n: int):
        """Views that together hold ids start..start+n-1, one for each record batch."""
        while n > 0:
            k = int(np.searchsorted(self.ends, start, side="right")) - 1
            a = start - int(self.ends[k])
            got = self._values(k)[0][a:a + n]
            yield got
            start, n = start + got.size, n - got.size

    def documents(self):
        for k in range(self.index.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.index.get_batch(k).columns))


def write_tokens(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """Encode and write ``docs`` below ``folder``; the written manifest with each shard's
    first token (``start``: tokens of all shards before it)."""
    id_type = to_arrow_type(docs.schema[doc_id].dataType)
    ordered = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def write(batches):
        encode, shard = encoder(path), None
        for batch in batches:
            for doc, t in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                if shard is None:
                    shard = ShardWriter(folder, id_type, encode.kind, sequence)
                shard.add(doc, np.append(encode(t), encode.kind.type(end_id)))
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict({
                "part": [TaskContext.get().partitionId()], "path": [shard.path], "n_docs": [shard.n_docs],
                "n_tokens": [shard.n_tokens], "n_sequences": [shard.n_sequences]})

    manifest = written(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    # one row per shard
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_documents(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    shards = max(1, manifest.count())
    arrow_id = to_arrow_type(spark.createDataFrame([], f"x {id_type}").schema["x"].dataType)
    schema = pa.schema([("doc_id", arrow_id), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def scan(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard, out = Shard(path), []
                for doc, start, n in shard.documents():
                    crc = 0
                    for ids in shard.tokens(start, n):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    out.append((doc, first + start, n, crc))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return (manifest.select("path", "start").repartition(shards)
            .mapInArrow(scan, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` into a new shared folder and read the documents back."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, path, fresh_folder(spark, "token-files"), doc_id=doc_id, **options)
    return read_documents(spark, manifest, docs.schema[doc_id].dataType.simpleString())
