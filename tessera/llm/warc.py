"""WARC archives written and read as chunked record tables.

A record's payload is never held whole on the way through an archive: the
writer cuts it into chunk rows (record, chunk number, bytes) of ``chunk_bytes``
and streams them into the file; the reader streams an archive back into rows of
the same shape.  Each chunk row carries the digest of the payload up to and
including that chunk, so the last row has the record's digest and length, and a
reader can check a record as far as it has come.

Archives are gzip files with one member a record, in a folder that driver and
executors share (any store that ``pyarrow.fs`` opens by URI).  A task writes
under a name of its own attempt and reports the name when done; only reported
files are read, so a retried or lost task leaves nothing behind that counts.

Of records with equal payloads of at least ``revisit_bytes`` bytes, that with
the smallest id is a response and the others revisit it.  Ids are integers;
rows that share the smallest id are all responses; rows with a null id revisit
the response if there is one, and are responses if no row has an id.  Null
payloads are as empty ones.  Repeated rows are records of their own, an empty
table makes no archive, and other columns, of any name, are left alone.

The writer gets a payload whole, as the table's row holds it, and hands it on
in chunks; the reader never holds more than a chunk of one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_folder

RECORDS = "record long, url string, chunk int, offset long, size int, payload binary, running_digest string, last boolean, record_type string, refers_to long, payload_digest string, payload_bytes long, record_urn string, refers_to_urn string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(payload: memoryview, size: int) -> Iterator[tuple[int, int, memoryview, str, bool]]:
    """(chunk number, offset, bytes, digest so far, last) of one payload; an empty one has one empty chunk."""
    sha, at, k = hashlib.sha1(), 0, 0
    while True:
        part = payload[at : at + size]
        sha.update(part)
        yield k, at, part, base32(sha.digest()), at + len(part) >= len(payload)
        at, k = at + len(part), k + 1
        if at >= len(payload):
            return


def _members(name: int | str, url: str | None, kind: str, digest: str, refers: int | None, chunks: Iterator, length: int, whole: int) -> Iterator[bytes]:
    """One record as a gzip member, piece by piece."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Target-URI: {quote(url or '', safe='/:?=&#%+~@!$,;()*[]')}"]
    if refers is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers}>")
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else ["Content-Type: text/html"]
    head += [f"X-Payload-Length: {whole}", f"Content-Length: {length}"]
    zip_ = zlib.compressobj(3, zlib.DEFLATED, 31)
    yield zip_.compress(("\r\n".join(head) + "\r\n\r\n").encode())
    for part in chunks:
        yield zip_.compress(part)
    yield zip_.compress(b"\r\n\r\n") + zip_.flush()


def _write(folder: str, chunk_bytes: int, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, made = TaskContext.get(), []
        out, path, n = None, "", 0
        for batch in batches:
            payloads = pc.fill_null(batch.column("payload"), b"")
            for i in range(batch.num_rows):
                name, url, digest, kind, refers = (batch.column(c)[i].as_py() for c in ("record", "url", "digest", "record_type", "refers_to"))
                whole = memoryview(payloads[i].as_buffer())
                body = whole if kind == "response" else memoryview(b"")
                if out is None or out.tell() >= roll_bytes:
                    if out is not None:
                        out.close()
                        made.append((path, n))
                    path, n = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz", 0
                    out = store.open_output_stream(path)
                for piece in _members(name if name is not None else "", url, kind, digest, refers, (c[2] for c in chunk_rows(body, chunk_bytes)), len(body), len(whole)):
                    out.write(piece)
                n += 1
        if out is not None:
            out.close()
            made.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([k for _, k in made], pa.int64())], names=["path", "records"])

    return run


def marked(pages: DataFrame, id_col: str, url_col: str, payload: Column, revisit_bytes: int) -> DataFrame:
    """``record, url, payload, digest, record_type, refers_to`` of every row.

    Digests are grouped with a partial count and minimum in each task, so a
    payload that very many rows share sends a row a task; only the digests that
    occur more than once are joined back.
    """
    own = pages.select(F.col(id_col).cast("long").alias("record"), F.col(url_col).alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    own = own.withColumn("sha", F.unhex(F.sha1("payload")))
    large = own.select("record", "sha", F.octet_length("payload").alias("size")).where(F.col("size") >= revisit_bytes)
    first = large.groupBy("sha").agg(F.min("record").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    # joined by a key of its own, so that the adaptive plan can split a payload that very many rows share
    revisits = large.join(first.select(F.xxhash64("sha").alias("_h"), F.col("sha").alias("_sha"), "first"), (F.xxhash64("sha") == F.col("_h")) & (F.col("sha") == F.col("_sha")))
    revisits = revisits.where(~F.col("record").eqNullSafe(F.col("first"))).select(F.col("record").alias("key"), F.col("sha").alias("key_sha"), "first").distinct()
    joined = own.join(revisits, own.record.eqNullSafe(revisits.key) & (own.sha == revisits.key_sha), "left")
    return joined.select("record", "url", "payload", "sha", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32_column(sha: Column) -> Column:
    """Base 32 of a 20-byte digest: 32 groups of five bits."""
    hexed = F.hex(sha)
    groups = []
    for k in range(4):  # 40 bits, ten hexadecimal digits
        part = F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("long")
        groups += [F.substring(F.lit(_B32), (F.call_function("shiftright", part, F.lit(35 - 5 * i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*groups)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = 1 << 20, roll_bytes: int = 256 << 20, revisit_bytes: int = 0) -> DataFrame:
    """Write a record for every row; returns the manifest (``path, records``), read back from the shared folder."""
    spark = pages.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = marked(pages, id_col, url_col, F.encode(F.col(payload_col), "UTF-8"), revisit_bytes).withColumn("digest", _base32_column(F.col("sha"))).drop("sha")
    manifest = rows.mapInArrow(_write(folder, chunk_bytes, roll_bytes), "path string, records long")
    return settled(manifest, "warc-manifest")


class _Stream:
    """Bytes of a multi-member gzip file, decompressed as they are asked for."""

    def __init__(self, raw, size: int):
        self.raw, self.size, self.left, self.unzip, self.more, self.ready = raw, size, b"", None, False, bytearray()

    def fill(self, n: int) -> bool:
        while len(self.ready) < n:
            if not self.left and (self.unzip is None or not self.more):
                self.left = self.raw.read(self.size)
                if not self.left:
                    return False
            if self.unzip is None:
                self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(self.left, self.size)
            self.ready += got
            self.more = len(got) == self.size  # the rest of what it has read may still be inside
            if self.unzip.eof:
                self.left, self.unzip, self.more = self.unzip.unused_data, None, False
            else:
                self.left = self.unzip.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def head(self) -> dict[str, str] | None:
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.fill(len(self.ready) + 1):
                return None
        lines = self.take(end + 4).decode(errors="replace").split("\r\n")
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _read(folder: str, chunk_bytes: int, payloads: bool):
    def name(urn: str | None) -> str | None:
        return (urn or "").strip().removeprefix("<").removesuffix(">").removeprefix("urn:page:") or None

    def page(urn: str | None) -> int | None:
        own = name(urn) or ""
        return int(own) if own.lstrip("-").isdigit() else None

    def rows(paths: Iterator[str]) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(folder)
        for path in paths:
            with store.open_input_stream(path) as raw:
                stream = _Stream(raw, chunk_bytes)
                while (head := stream.head()) is not None:
                    left, at, k, sha, kind = int(head["content-length"]), 0, 0, hashlib.sha1(), head.get("warc-type", "")
                    urn, given = head.get("warc-record-id"), head.get("warc-payload-digest", "")
                    stated = given.removeprefix("sha1:") if given.startswith("sha1:") else None
                    bare = kind == "response" and not head.get("content-type", "").startswith("application/http")
                    own = kind != "revisit"
                    while True:
                        part = stream.take(min(left, chunk_bytes))
                        if len(part) < min(left, chunk_bytes):
                            raise ValueError(f"{path}: record {urn} is cut short")
                        sha.update(part)
                        left -= len(part)
                        running = base32(sha.digest())
                        if not left and bare and stated is not None and running != stated:
                            raise ValueError(f"{path}: record {urn} has digest {running}, not {stated}")
                        whole = at + len(part) if own or "x-payload-length" not in head else int(head["x-payload-length"])
                        digest = running if own or stated is None else stated
                        yield page(urn), head.get("warc-target-uri"), k, at, len(part), part if payloads else None, running, not left, kind, page(head.get("warc-refers-to")), digest, whole, name(urn), name(head.get("warc-refers-to"))
                        at, k = at + len(part), k + 1
                        if not left:
                            break
                    stream.take(4)

    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, ends = [], 0, 0
            for row in rows(iter(batch.column("path").to_pylist())):
                held.append(row)
                size += len(row[5] or b"") + 200
                if size >= 4 << 20:
                    yield packed(held)
                    held, size = [], 0
            yield packed(held)

    return run


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = 1 << 20, payloads: bool = True) -> DataFrame:
    """The chunk rows of the archives in ``manifest`` (column ``path``); one task a file at most.

    Archives of other writers are read too: records of every type, ids as texts
    in ``record_urn`` and ``refers_to_urn`` (``record`` and ``refers_to`` are
    null where they are not this writer's numbers), and digests checked where
    they are stated for the bytes that the record holds, computed otherwise.

    Columns: ``RECORDS``.  ``payload`` is null without ``payloads``;
    ``payload_digest`` and ``payload_bytes`` are those of the payload as far as
    it has been read, for a revisit those of the full payload that it stands for.
    """
    files = manifest.select("path")
    n = max(1, files.count())
    return files.repartition(n, F.xxhash64("path")).mapInArrow(_read(folder, chunk_bytes, payloads), RECORDS)


def archive_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}" if folder.startswith("/") else folder


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its last chunk row, which has the whole length and digest."""
    return chunks.where("last").select("record", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    folder = archive_folder(spark)
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    out = records(read_archives(manifest, folder, payloads=False))
    return out.select(F.col("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
