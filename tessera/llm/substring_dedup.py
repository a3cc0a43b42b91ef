"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document.  A word goes if a
window over it also starts in a document with a smaller id.

1. Every window holds a minimiser: the least hash among its ``anchor``-word
   runs, chosen by the window's content alone.  Equal windows have equal
   minimisers, so the number of documents with a minimiser is never below the
   number of documents with the window.  Each task counts its minimisers, once
   a document, in a count-min sketch (counts saturate at two); the partitions'
   sketches are merged block by block.
2. The merged sketch, one bit a cell, is broadcast.  Its size follows the
   length of the texts, up to ``max_cells``.  Beyond ``FULL`` characters a cell
   it would rule out little, so its cells are dealt out instead: the minimisers
   are counted where their cells are (a cell for each 64-bit hash), and each
   document gets back those of its own that are counted twice.  Counts are never
   too low either way, and the results are the same.
3. Windows estimated repeated are grouped exactly, by 128 bits of hash.  Each
   chunk of text first keeps the smallest document of each window, so a
   passage of very many documents sends one row a chunk.

Equality of windows is told by 128 bits of hash, and rows of one id by 24 bits
of their text's hash besides; two different windows of a corpus of 10^14 are
taken for equal with a probability of about 10^-11.  An empty table gives an
empty one, and columns of any name but those read are left alone.

Null or empty texts have no words and keep nothing.  A null id is neither
smaller nor larger than another, so its document keeps all its words.  Rows
that share an id are apart as documents only if their ids differ: equal ids
never remove each other's words, and rows equal in id and text give equal rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, settled
from .text import Words, chunks, mix, windows

DEPTH = 2
BLOCK_BITS = 16
#: Characters of text a cell of the broadcast sketch, at most: some six cells a minimiser are left.
FULL = 16


def minimisers(words: Words, hashes: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and its minimiser's hash."""
    at, _ = windows(words, hashes, width)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    where, value = windows(words, hashes, anchor)
    dense = np.full(len(hashes), np.uint64(2**64 - 1))
    dense[where] = value
    span, n = width - anchor + 1, len(dense)
    least, have = dense, 1
    while have * 2 <= span:  # least of 2, 4, 8, ... in a row
        least = np.minimum(least[: n - have], np.concatenate([least[have:], np.full(have, least[-1])])[: n - have]) if n > have else least
        have *= 2
        n = len(least)
    return at, np.minimum(least[at], least[at + span - have])


def cells(value: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(value + np.uint64(0x632BE59BD9B4E019) * np.uint64(row + 1)) >> np.uint64(64 - bits)


def _count(bits: int, width: int, anchor: int):
    """Per task: the sketch's blocks, as the cells counted once and those counted more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                at, least = minimisers(words, words.hashes(), width, anchor)
                row = words.row()[at]
                change = np.ones(len(at), bool)
                change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                least, row = least[change], row[change]
                order = np.lexsort((row, least))
                least, row = least[order], row[order]
                change = np.ones(len(least), bool)
                change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                found.append(least[change])
            value = np.concatenate(found) if found else np.zeros(0, np.uint64)
            for level in range(DEPTH):
                cell, n = np.unique(cells(value, level, bits), return_counts=True)
                block = (cell >> np.uint64(BLOCK_BITS)).astype(np.int64)
                low = cell.astype(np.uint16)
                cuts = np.flatnonzero(np.diff(block)) + 1
                once = [a[m == 1].tobytes() for a, m in zip(np.split(low, cuts), np.split(n, cuts), strict=True)] if len(low) else []
                more = [a[m > 1].tobytes() for a, m in zip(np.split(low, cuts), np.split(n, cuts), strict=True)] if len(low) else []
                which = block[np.concatenate([[0], cuts])] if len(low) else block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([level] * len(which), pa.int32()), pa.array(which, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                    names=["level", "block", "once", "more"],
                )

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << BLOCK_BITS, np.uint8)
    for once, more in zip(pdf["once"], pdf["more"], strict=True):
        at = np.frombuffer(once, np.uint16)
        total[at] = np.minimum(total[at] + 1, 2)
        total[np.frombuffer(more, np.uint16)] = 2
    return pd.DataFrame({"level": pdf["level"].iloc[:1], "block": pdf["block"].iloc[:1], "bits": [np.packbits(total > 1).tobytes()]})


def sketch(docs: DataFrame, width: int, anchor: int, max_cells: int, size: int) -> tuple[int, list[np.ndarray]]:
    """Cell bits and, for each row of the merged sketch, a bit for each cell counted twice or more; ``size`` is the texts' length."""
    bits = min(max(int(size).bit_length() - 2, 17), int(max_cells).bit_length() - 1)
    rows = (
        docs.select("text")
        .mapInArrow(_count(bits, width, anchor), "level int, block long, once binary, more binary")
        .groupBy("level", "block")
        .applyInPandas(_merge, "level int, block long, bits binary")
    )
    plane = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(DEPTH)]
    step = 1 << (BLOCK_BITS - 3)
    for r in rows.toLocalIterator():  # at most DEPTH * max_cells bits
        plane[r.level][r.block * step : (r.block + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return bits, plane


def estimated(least: np.ndarray, merged: tuple[int, list[np.ndarray]]) -> np.ndarray:
    """Whether the merged sketch counts the minimisers in two documents or more."""
    bits, plane = merged
    out = np.ones(len(least), bool)
    for level in range(DEPTH):
        cell = cells(least, level, bits).astype(np.int64)
        out &= (plane[level][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def _minimiser_rows(width: int, anchor: int):
    """The different minimisers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                at, least = minimisers(words, words.hashes(), width, anchor)
                row = words.row()[at]
                order = np.lexsort((least, row))
                least, row = least[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                own = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), part.column("doc_id").take(own), part.column("tag").take(own)], names=["value", "doc_id", "tag"])

    return run


def prefiltered(docs: DataFrame, width: int, anchor: int, max_cells: int) -> tuple[DataFrame, object]:
    """``docs`` (``doc_id, text, tag``) with ``often``, and the broadcast sketch; one of the two says what may be repeated."""
    size = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    if size <= FULL * max_cells:
        shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, width, anchor, max_cells, size))
        return docs.withColumn("often", F.lit(None).cast("array<bigint>")), shared
    rows = docs.where("doc_id is not null").mapInArrow(_minimiser_rows(width, anchor), "value long, doc_id long, tag long")
    twice = rows.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(apart(F.col("value")).alias("_v"))
    back = rows.join(twice, apart(F.col("value")) == F.col("_v")).groupBy(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).agg(F.collect_set("value").alias("often"))
    back = settled(back, "repeated-minimisers")
    return docs.join(back, (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_t")), "left").select("doc_id", "text", "tag", "often"), None


def maybe_repeated(part: pa.RecordBatch, row: np.ndarray, least: np.ndarray, shared) -> np.ndarray:
    """Whether the minimisers, of the given rows of ``part``, may stand in two documents or more."""
    if shared is not None:
        return estimated(least, shared.value)
    column = part.column("often")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(part.num_rows, dtype=np.uint64), count)
    return np.isin(mix(least ^ mix(row.astype(np.uint64))), mix(flat ^ mix(of)))


_NARROW = "h1 long, h2 long, doc_id long, at long, n int"


def _candidates(shared, width: int, anchor: int):
    """Windows estimated repeated: one row each (n = 0), or runs known to be repeats (n > 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = part.column("doc_id")
                words = Words(part.column("text"))
                hashes = words.hashes()
                at, least = minimisers(words, hashes, width, anchor)
                row = words.row()[at]
                keep = np.asarray(ids.is_valid())[row] & maybe_repeated(part, row, least, shared)
                if not keep.any():
                    continue
                pick = np.flatnonzero(keep)
                h1, h2 = (windows(words, hashes, width, s)[1][pick].view(np.int64) for s in (False, True))
                row, at = row[pick], at[pick]
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)[row]
                order = np.lexsort((doc, h2, h1))
                a, b, d = h1[order], h2[order], doc[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
                known = np.zeros(len(a), bool)
                known[order] = d > first
                tag = (np.asarray(part.column("tag")).astype(np.int64) & 0xFFFFFF) << 36
                place = tag[row] | (at - words.first[row])
                rest = ~known
                yield _rows(h1[rest], h2[rest], doc[rest], place[rest], np.zeros(rest.sum(), np.int32))
                if known.any():
                    place, doc = place[known], doc[known]
                    begin = np.ones(len(place), bool)
                    begin[1:] = (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
                    begin = np.flatnonzero(begin)
                    n = np.diff(np.append(begin, len(place))).astype(np.int32)
                    yield _rows(mix(place[begin].view(np.uint64)).view(np.int64), doc[begin], doc[begin], place[begin], n)

    return run


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "doc_id", "at", "n"])


def _keep(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield kept(part)

    def kept(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        tags = np.asarray(part.column("tag")).astype(np.int64) & 0xFFFFFF
        for i, text in enumerate(part.column("text").cast(pa.large_string()).to_pylist()):
            words = text.encode().split() if text else []
            spans, gone = part.column("spans")[i].values, 0
            stays = words
            if spans is not None and len(spans):
                at, n = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n"))
                own = (at >> 36) == tags[i]
                at, n = at[own] & 0xFFFFFFFFF, np.maximum(n[own], 1)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.minimum(at + n + width - 1, len(words)), -1)
                stay = np.cumsum(edge)[:-1] == 0
                gone = int(len(words) - stay.sum())
                stays = list(itertools.compress(words, stay.tolist()))
            out.append((part.column("doc_id")[i].as_py(), len(words), gone, b" ".join(stays)))
        ids, total, gone, texts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in texts], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )

    return run


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, anchor: int = 20, max_cells: int = 1 << 28) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tag"))
    sifted, shared = prefiltered(own, width, min(anchor, width), max_cells)
    found = sifted.mapInArrow(_candidates(shared, width, min(anchor, width)), _NARROW)
    repeats = spark.sql(
        """select doc_id as key, collect_list(struct(at, n)) as spans
           from (select doc_id, at, n, min(doc_id) over (partition by h1, h2) as first from {found})
           where n > 0 or doc_id > first group by doc_id""",
        found=found,
    )
    joined = own.join(repeats, own.doc_id == repeats.key, "left").select("doc_id", "text", "tag", F.coalesce("spans", F.array().cast("array<struct<at:bigint,n:int>>")).alias("spans"))
    return joined.mapInArrow(_keep(width), "doc_id long, n_words long, n_removed long, kept_text string")


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = drop_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
n as (select doc_id, ws, len(ws) n from w),
s as (select doc_id, unnest(range(1, n - 48)) i, ws from n where n >= 50),
h as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) k from s),
m as (select k, min(doc_id) f from h group by k),
r as (select distinct h.doc_id, h.i + unnest(range(50)) i from h join m using (k) where h.doc_id > m.f),
g as (select doc_id, list(i) gone, count(*) c from r group by doc_id),
p as (select doc_id, unnest(range(1, n + 1)) i, unnest(ws) word from n),
k as (select p.doc_id, string_agg(p.word, ' ' order by p.i) t from p left join r on r.doc_id = p.doc_id and r.i = p.i where r.i is null group by p.doc_id)
select n.doc_id, n.n::bigint n_words, coalesce(g.c, 0)::bigint n_removed, sha256(coalesce(k.t, '')) kept_sha256
from n left join g using (doc_id) left join k using (doc_id)
"""
