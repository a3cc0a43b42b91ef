"""Repeated passages by sparse suffix arrays.

A passage is ``width`` words or more that two documents share.  Of all suffixes
of the texts, those are kept that start at a minimiser: the least hash among
the ``anchor``-word runs of some ``width``-word window.  A minimiser is chosen
by the window's words alone, so every shared window has one at the same place
in both documents.  Suffixes whose minimiser stands in one document only, by a
count-min sketch that never counts too few, are no one's neighbours and go.

The kept suffixes are sorted by the words around their start: for each stretch
of ``step`` places that the minimiser has in the windows it stands for, by the
``width - step + 1`` words that those windows share (as a 64-bit digest), then
by document and place.  Each suffix is compared with its neighbour before it
and with the first of its run, both in documents with smaller ids.  Compared
suffixes are extended left and right, word by word, over both whole documents;
matches of ``width`` words or more are passages.  Each task keeps a document's
passages that lie in no other one, so a document of a large group of near
copies does not have a row for each pair.

Neighbours are taken within a run of equal windows, and not simply in the order
of suffixes: the neighbour there shares most words to the right, but a passage
may lie mostly to the left of its minimiser, and then the document that shares
it can stand further off in that order.

Within a chunk of text all suffixes of a run are compared with the chunk's
first, which alone is sorted with the others', so a passage of very many
documents sends a row a chunk.  Windows are told apart by 64 bits of hash, but
only words that are equal, one by one (by 64 bits each), make a passage.  Rows with a null id or text take no part; rows
that share an id are not compared with each other, and repeated rows have the
same passages.  Texts of any length are whole; an empty table has no passages;
columns of any name but those read are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .substring_dedup import _keep, maybe_repeated, minimisers, prefiltered
from .text import Words, chunks, mix, windows

_PLACE = (1 << 36) - 1


def sparse_suffixes(words: Words, hashes: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, its minimiser's place (the first of equal ones) and hash."""
    at, _ = windows(words, hashes, width)
    where, value = windows(words, hashes, anchor)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    least = np.full(len(hashes), np.uint64(2**64 - 1))
    least[where] = value
    place, span, have = np.arange(len(hashes)), width - anchor + 1, 1
    while have * 2 <= span:  # least of 2, 4, 8, ... in a row
        right = least[have:] < least[:-have]
        place = np.where(right, place[have:], place[:-have])
        least = np.where(right, least[have:], least[:-have])
        have *= 2
    right = least[at + span - have] < least[at]
    return at, np.where(right, place[at + span - have], place[at]), np.where(right, least[at + span - have], least[at])


_ROWS = ["key", "doc_id", "place", "ref_id", "ref_place"]


def _suffixes(shared, width: int, anchor: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                at, suffix, least = sparse_suffixes(words, hashes, width, anchor)
                often = maybe_repeated(part, words.row()[at], least, shared)
                at, suffix = at[often], suffix[often]
                begin = np.unique(suffix - (suffix - at) // step * step)
                first, value = windows(words, hashes, width - step + 1)
                row, ids, tags = words.row(), part.column("doc_id").to_numpy(), part.column("tag").to_numpy().astype(np.int64)
                key, doc = value[np.searchsorted(first, begin)].view(np.int64), ids[row[begin]]
                place = (tags[row[begin]] << 36) | (begin - words.first[row[begin]])
                order = np.lexsort((place, doc, key))
                key, doc, place = key[order], doc[order], place[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
                local = doc[lead] != doc
                key = np.where(local, mix(key.view(np.uint64) ^ mix(place.view(np.uint64) + doc.astype(np.uint64))).view(np.int64), key)
                refs = [pa.array(x[lead], mask=~local) for x in (doc, place)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(place), *refs], names=_ROWS)

    return run


def _repeating(shared, width: int, anchor: int):
    """The documents with a suffix that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                at, least = minimisers(words, words.hashes(), width, anchor)
                keep = np.zeros(part.num_rows, bool)
                row = words.row()[at]
                keep[row[maybe_repeated(part, row, least, shared)]] = True
                yield part.filter(pa.array(keep))

    return run


def maximal(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, stop, ref, ref start), those inside no other; of equal ones the least ref's."""
    out, reach = [], -1
    for row in sorted(found, key=lambda x: (x[0], -x[1], x[2:])):
        if row[1] > reach:
            out.append(row)
            reach = row[1]
    return out


def _extend(width: int):
    """Passages of each document, from rows in which those of one document are next to each other."""

    def matches(x: np.ndarray, y: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
        low, high = max(0, shift), min(len(x), len(y) + shift)
        same = np.zeros(high - low + 2, bool)
        same[1:-1] = x[low:high] == y[low - shift : high - shift]
        edge = np.flatnonzero(same[1:] != same[:-1])
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= width
        return [(low + s, low + e, low + s - shift) for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, found = None, []

        def packed() -> pa.RecordBatch:
            names = ["doc_id", "tag", "ref_doc_id", "start", "n_words", "ref_start"]
            rows = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names=names)
            out.clear()
            return rows

        def finish() -> None:
            if now is not None:
                out.extend((*now, ref, start, stop - start, at) for start, stop, ref, at in maximal(found))

        for batch in batches:
            for part in chunks(batch, "text", "ref_text"):
                keys = list(zip(part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), strict=True))
                heads = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
                one, two = Words(part.column("text").take(pa.array(heads))), Words(part.column("ref_text"))
                a, b = one.hashes(), two.hashes()
                refs, at = part.column("ref_id").to_pylist(), -1
                for i, key in enumerate(keys):
                    at += i == heads[min(at + 1, len(heads) - 1)]
                    if key != now:
                        finish()
                        now, found = key, []
                    x, y = a[one.first[at] : one.first[at + 1]], b[two.first[i] : two.first[i + 1]]
                    for shift in part.column("shifts")[i].as_py():
                        found += [(s, e, refs[i], r) for s, e, r in matches(x, y, shift)]
                    if len(found) > 10_000:
                        found = maximal(found)
                if len(out) > 20_000:
                    yield packed()
        finish()
        yield packed()

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0xFFFFFF)).alias("tag"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, anchor: int = 20, step: int = 1, max_cells: int = 1 << 28) -> DataFrame:
    """``doc_id, start, n_words, ref_doc_id, ref_start, tag`` of passages that also stand in a document with a smaller id.

    A passage lies in no other one of its document, and each is given once, with
    one of the documents that have it; ``tag`` tells rows of one id apart.
    """
    own = _documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    own, shared = prefiltered(own, width, anchor, max_cells)
    sparse = own.mapInArrow(_suffixes(shared, width, anchor, step), "key long, doc_id long, place long, ref_id long, ref_place long")
    compared = sparse.sparkSession.sql(
        """select doc_id, place, explode(array_distinct(array(leader, before, near))) as ref from (
             select doc_id, place, first(struct(doc_id, place)) over w as leader, lag(struct(doc_id, place)) over w as before,
                    if(ref_id is null, null, struct(ref_id as doc_id, ref_place as place)) as near
             from {sparse} window w as (partition by key order by doc_id, place))""",
        sparse=sparse,
    ).where("ref.doc_id < doc_id")
    tag, ref_tag = F.call_function("shiftright", F.col("place"), F.lit(36)), F.call_function("shiftright", F.col("ref.place"), F.lit(36))
    shift = F.col("place").bitwiseAND(F.lit(_PLACE)) - F.col("ref.place").bitwiseAND(F.lit(_PLACE))
    pairs = compared.select("doc_id", tag.alias("tag"), F.col("ref.doc_id").alias("ref_id"), ref_tag.alias("ref_tag"), shift.alias("shift"))
    pairs = pairs.groupBy("doc_id", "tag", "ref_id", "ref_tag").agg(F.collect_set("shift").alias("shifts"))
    own = own.mapInArrow(_repeating(shared, width, anchor), own.schema).drop("often")
    refs = own.select(F.col("doc_id").alias("ref_id"), F.col("text").alias("ref_text"), F.col("tag").alias("ref_tag"))
    joined = pairs.join(refs, ["ref_id", "ref_tag"]).join(own, ["doc_id", "tag"])
    joined = joined.select("doc_id", "tag", "ref_id", "shifts", "text", "ref_text").sortWithinPartitions("doc_id", "tag")
    found = joined.mapInArrow(_extend(width), "doc_id long, tag long, ref_doc_id long, start long, n_words long, ref_start long")
    before = W.partitionBy("doc_id", "tag").orderBy("start", F.desc("n_words"), "ref_doc_id", "ref_start").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("n_words")).over(before)
    found = found.withColumn("reach", F.coalesce(reach, F.lit(-1))).where("start + n_words > reach")
    return found.select("doc_id", "start", "n_words", "ref_doc_id", "ref_start", "tag")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, **options) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_text``: texts without the passages of ``repeats``."""
    spans = repeats(docs, id_col, text_col, width, **options).groupBy(F.col("doc_id").alias("key"), F.col("tag").alias("key_tag"))
    spans = spans.agg(F.collect_set(F.struct(F.call_function("shiftleft", F.col("tag"), F.lit(36)).bitwiseOR(F.col("start")).alias("at"), F.col("n_words").cast("int").alias("n"))).alias("spans"))
    own = _documents(docs, id_col, text_col)
    joined = own.join(spans, (own.doc_id == spans.key) & (own.tag == spans.key_tag), "left")
    joined = joined.select("doc_id", "text", "tag", F.coalesce("spans", F.array().cast("array<struct<at:bigint,n:int>>")).alias("spans"))
    return joined.mapInArrow(_keep(1), "doc_id long, n_words long, n_removed long, kept_text string")


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repeats(table(spark, sf_dir, "documents")).drop("tag")
