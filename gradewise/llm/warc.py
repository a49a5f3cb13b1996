"""WARC archives of pages: writing, reading, and assembly of captures.

Each page is written as three records of one archive: the request, the response (or a
revisit of an earlier capture of the same payload) and metadata.  Request and metadata
name the capture in WARC-Concurrent-To.  Reading gives one row per record; assembly joins
request and metadata records to the capture that they are concurrent to and emits one
nested row per capture; a revisit takes its payload's length from the response it refers to.

Records are gzip members of their own.  A task writes one archive under a name of its own
attempt; the written manifest lists the archives of accepted attempts, so lost and repeated
attempts leave nothing that is read.  Memory is bounded by one record.

Which capture of a payload of at least REVISIT_BYTES is kept: that with the largest page id
(rows with that very id are all responses).  The payload's digest is the shuffle key; the
join on it is a plain sort-merge join, which Spark splits where a payload is very frequent.

Cases: a null payload is the empty one; null urls have no WARC-Target-URI; a null page id
stays null and never is the largest; repeated rows are captures of their own; control
characters in a url are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import fresh_folder, local_path, written

REVISIT_BYTES = 1000
#: There is no capture time in the table; a fixed one keeps archives reproducible.
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = ("archive string, record_id string, record_type string, concurrent_to string, refers_to string, "
           "target_uri string, payload_bytes long, payload_digest string, page_id long, payload binary")


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def digest_header(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member with the record's headers, block and end."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def capture_records(name: str, page_id, url, payload: bytes, digest: str, refers_to, kept_id) -> list[bytes]:
    """Request, response or revisit, and metadata of one page; ``name`` is unique to it."""
    own = kept_id or record_id(f"{name}/capture")
    target = None if url is None else header_safe(url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", record_id(f"{name}/request")),
                      ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")],
                     f"GET {target or '*'} HTTP/1.1\r\n\r\n".encode())
    head = HTTP.format(len(payload)).encode()
    kind = [("WARC-Type", "response")] if refers_to is None else [
        ("WARC-Type", "revisit"), ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    capture = record([*kind, ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest_header(digest)),
                      ("Content-Type", "application/http; msgtype=response")],
                     head + payload if refers_to is None else head)
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(f"{name}/metadata")),
                       ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/warc-fields")],
                      b"" if page_id is None else f"page_id: {page_id}\r\n".encode())
    return [request, capture, metadata]


def with_kept(pages: DataFrame, page_id: str, payload: str, url: str, least: int) -> DataFrame:
    """Pages with digest and ``kept``: the largest page id of an equal payload (null: too small)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    kept = (rows.filter(F.octet_length("payload") >= least)
            .groupBy(F.col("digest").alias("kept_digest")).agg(F.max("page_id").alias("kept")))
    return rows.join(kept, F.col("digest") == F.col("kept_digest"), "left").drop("kept_digest")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", payload: str = "html",
                   url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """Write the pages as archives below ``folder``; the written manifest."""
    def write(batches):
        out, n, size, kept_here = None, 0, 0, set()
        for batch in batches:
            for page, target, body, digest, kept in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, root = local_path(folder)
                    system.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                # the kept response has an id that revisits elsewhere can know
                known = None if kept is None else record_id(f"payload/{digest}")
                is_kept = kept is not None and page == kept
                refers = known if kept is not None and not is_kept else None
                own = known if is_kept and digest not in kept_here else None
                if own:
                    kept_here.add(digest)
                for part in capture_records(f"{name}/{n}", page, target, body.encode(), digest, refers, own):
                    out.write(part)
                    n, size = n + 1, size + len(part)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    rows = with_kept(pages, page_id, payload, url, least).select("page_id", "url", "payload", "digest", "kept")
    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def parsed(stream):
    """(headers in lower case, block) of each record of an unpacked archive."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {version[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def record_row(archive: str, headers: dict, block: bytes) -> tuple:
    kind = headers["warc-type"]
    payload = digest = page = None
    if kind in ("response", "revisit"):
        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    if kind == "metadata":
        found = re.search(rb"^page_id: (-?\d+)\r$", block, re.M)
        page = int(found[1]) if found else None
    return (archive, headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
            headers.get("warc-target-uri"), None if payload is None else len(payload), digest, page, payload)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the listed archives (RECORDS)."""
    archives = max(1, manifest.count())
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORDS.split(", ")])

    def scan(batches):
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, root = local_path(path)
                rows, size = [], 0
                with system.open_input_stream(root, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parsed(stream):
                        row = record_row(path, headers, block)
                        rows.append(row if with_payload else (*row[:-1], None))
                        size += len(block) if with_payload else 300
                        if size > 4 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    return manifest.select("path").repartition(archives).mapInArrow(scan, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, url, capture, request, metadata, revisited.

    Requests and metadata are joined by archive and concurrent-to identifier; of several
    that name one capture the first by record id counts.  Captures without a request or
    metadata record have nulls there; requests and metadata of a missing capture are left out.
    """
    key = ["archive", "record_id"]

    def concurrent(kind, *fields):
        rows = records.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.groupBy("archive", F.col("concurrent_to").alias("record_id")).agg(
            F.min(F.struct(F.col("record_id").alias("id"), *fields)).alias(kind))

    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(
        *key, F.struct("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload").alias("capture"))
    joined = (captures.join(concurrent("request", "target_uri"), key, "left")
              .join(concurrent("metadata", "page_id", "target_uri"), key, "left"))
    rows = joined.select(F.col("metadata.page_id").alias("page_id"),
                         F.coalesce("metadata.target_uri", "request.target_uri").alias("url"),
                         "capture", "request", "metadata")
    # a kept payload's record id stands once, or once in each archive that holds a repeated row
    kept = (rows.filter(F.col("capture.record_type") == "response")
            .groupBy(F.col("capture.record_id").alias("kept_id"))
            .agg(F.min(F.struct("page_id", F.col("capture.payload_bytes").alias("payload_bytes"))).alias("revisited")))
    # a response looks for itself: null keys would all meet in one task
    wanted = F.coalesce("capture.refers_to", "capture.record_id")
    again = F.col("capture.record_type") == "revisit"
    return (rows.join(kept, wanted == F.col("kept_id"), "left")
            .withColumn("revisited", F.when(again, F.col("revisited"))).drop("kept_id"))


def archived_pages(pages: DataFrame, with_payload: bool = False, **options) -> DataFrame:
    """Write the pages into a new shared folder, read the archives back and assemble."""
    manifest = write_archives(pages, fresh_folder(pages.sparkSession, "warc"), **options)
    records = written(read_archives(manifest, with_payload), "warc-records")
    return assemble(records)
