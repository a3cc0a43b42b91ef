"""Language identification of mixed-language text.

A word is a run of ASCII letters and non-ASCII bytes.  Its score for a language
is the sum of the log-probabilities of its byte trigrams (word edges included,
A-Z lower-cased), counted per language on a labelled sample.  The script range
of a word's first letter narrows the languages to those whose sample has words
in that script; a script that no language has narrows nothing and scores
nothing.  The best sequence of languages over the words of a text, at a penalty
for each switch, is found by Viterbi; runs of one language are its spans.  The
prediction is the language with most words, its score their share.

The sample holds about ``sample_docs`` labelled documents of each language at
most, drawn by a hash of the id.  Texts that are null or have no letter are
``und`` with score 0, as is every text if nothing is labelled.

A text stays whole in one language for certain if no other language gains more
than half the penalty on any stretch of it; the recursion runs on the others
only, step by step over all texts of a pool at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, chunks

FEATURES = 1 << 16
#: More than any two switches cost.
EXCLUDED = 1000.0
#: First and last code points of script blocks.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Ethiopic": [(0x1200, 0x137F)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[0x41:0x5B] += 32


def _script_table() -> np.ndarray:
    """Script number (from 1; 0 is any other) by the first two bytes of a character."""
    out = np.zeros(1 << 16, np.uint8)
    for k, blocks in enumerate(SCRIPTS.values(), 1):
        for low, high in blocks:
            for c in range(low, high + 1, 1 if high < 0x800 else 64):
                b = chr(c).encode()
                if len(b) == 1:
                    out[b[0] << 8 : (b[0] << 8) + 256] = k
                else:
                    out[b[0] << 8 | b[1]] = k
    return out


_SCRIPT = _script_table()


def trigrams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every byte of every word, each word's first place among them, and each word's script."""
    length = words.stop - words.start
    before = np.cumsum(length) - length
    own = _LOWER[words.data[words._inside]]
    left, right = np.empty_like(own), np.empty_like(own)
    left[1:], right[:-1] = own[:-1], own[1:]
    left[before], right[before + length - 1] = 32, 32
    feature = ((left * 0x9E3779B1 + own * 0x85EBCA77 + right * 0xC2B2AE3D) >> 7) & (FEATURES - 1)
    second = words.data[np.minimum(words.start + 1, len(words.data) - 1)].astype(np.int64)
    return feature, before, _SCRIPT[(words.data[words.start].astype(np.int64) << 8) | second]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in chunks(batch, "text"):
            words = Words(part.column("text"), ~_LETTER)
            feature, before, script = trigrams(words)
            length = words.stop - words.start
            row = words.row()
            for lang in set(part.column("lang").to_pylist()):
                mine = np.asarray([x == lang for x in part.column("lang").to_pylist()])
                of = mine[row]
                own = total.setdefault(lang, np.zeros(FEATURES + 256, np.int64))
                own[:FEATURES] += np.bincount(feature[np.repeat(of, length)], minlength=FEATURES)
                own[FEATURES:] += np.bincount(script[of], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["lang", "counts"])


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "counts": [sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).tobytes()]})


class Model:
    """Log-probabilities by language and feature, and the scripts of each language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        table = np.array([counts[x] for x in self.langs], np.float64).reshape(-1, FEATURES + 256)
        seen, script = table[:, :FEATURES], table[:, FEATURES:]
        self.logp = np.log((seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * FEATURES)).astype(np.float32)
        self.allowed = (script > 0.001 * script.sum(1, keepdims=True)).T  # script by language
        self.allowed[0] = True

    def scores(self, words: Words, floor: float = 8.0) -> np.ndarray:
        """Word by language: 0 for the best, no less than ``-floor``, and ``-EXCLUDED`` without the word's script."""
        out = np.zeros((len(words.start), len(self.langs)), np.float32)
        if not len(out):
            return out
        feature, before, script = trigrams(words)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.logp[k][feature], before)
        allowed = self.allowed[script]
        nobody = ~allowed.any(1)
        out[~allowed] -= 1e6
        out[nobody] = 0
        out -= out.max(1, keepdims=True)
        out = np.maximum(out, -floor)
        out[~allowed & ~nobody[:, None]] = -EXCLUDED
        return out


def fit(docs: DataFrame, sample_docs: int = 4000) -> Model:
    """``docs`` has ``doc_id, text, lang``; rows with a null text or lang teach nothing."""
    own = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    size = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not size:
        return Model({})
    rate = F.create_map(*(F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, sample_docs / n))))
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    sample = own.where(draw < rate[F.col("lang")]).select("text", "lang").repartition(8)
    counted = sample.mapInArrow(_count, "lang string, counts binary").groupBy("lang").applyInPandas(_sum, "lang string, counts binary")
    return Model({r.lang: np.frombuffer(r.counts, np.int64) for r in counted.collect()})


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language of every word of every text, all texts at once."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    size = np.array([len(scores[i]) for i in order])
    first = np.cumsum(size) - size
    flat = np.concatenate([scores[i] for i in order]).astype(np.float64)
    stay, come = np.zeros(flat.shape, bool), np.zeros(len(flat), np.int64)
    now = flat[first].copy()
    live = len(order)
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size[:live], -t, side="left"))
        at = first[:live] + t
        best = now[:live].argmax(1)
        jump = now[np.arange(live), best] - penalty
        keep = now[:live] >= jump[:, None]
        stay[at], come[at] = keep, best
        now[:live] = np.where(keep, now[:live], jump[:, None]) + flat[at]
    label = now.argmax(1)
    out = np.zeros(len(flat), np.int64)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = first[:live] + t
        out[at] = label[:live]
        label[:live] = np.where(stay[at, label[:live]], label[:live], come[at])
    back: list[np.ndarray] = [out[:0]] * len(scores)
    for place, i in enumerate(order):
        back[i] = out[first[place] : first[place] + size[place]]
    return back


def sure(score: np.ndarray, words: Words, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's best single language, and whether it is surely the best for every word."""
    rows = len(words.count)
    some = np.flatnonzero(words.count)
    best, gain = np.zeros(rows, np.int64), np.zeros(rows)
    if not len(some):
        return best, gain <= penalty / 2
    first = words.first[:-1][some]
    best[some] = np.add.reduceat(score.astype(np.float64), first, axis=0).argmax(1)
    row = words.row()
    base = score[np.arange(len(score)), best[row]]
    rank = np.arange(len(some)).repeat(words.count[some])
    for k in range(score.shape[1]):
        run = np.cumsum((score[:, k] - base).astype(np.float64))
        before = np.concatenate([[0], run[:-1]])
        zero = before[first].repeat(words.count[some])
        run, before = run - zero, before - zero
        apart = rank * (2 * float(np.abs(run).max()) + 1)  # keeps the running minimum within a row
        low = np.minimum.accumulate(before - apart) + apart
        gain[some] = np.maximum(gain[some], np.maximum.reduceat(run - low, first))
    return best, gain <= penalty / 2


def spans_of(label: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, word after the last, language) of each run."""
    if not len(label):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
    return [(a, b, int(label[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def _label(shared, penalty: float, pool_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value

        def packed(rows: list[list]) -> pa.RecordBatch:
            hard = [r for r in rows if r[2] is not None]
            for r, label in zip(hard, viterbi([r[2] for r in hard], penalty) if hard else [], strict=True):
                r[3] = spans_of(label)
            out = []
            for doc, letters, _, spans in rows:
                n = np.zeros(max(1, len(model.langs)), np.int64)
                for a, b, k in spans:
                    n[k] += b - a
                known = letters and n.sum() > 0 and len(model.langs) > 0
                out.append((doc, model.langs[int(n.argmax())] if known else "und", float(n.max() / n.sum()) if known else 0.0, [(a, b, model.langs[k]) for a, b, k in spans] if known else []))
            ids, pred, score, spans = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([[{"start": a, "stop": b, "lang": k} for a, b, k in s] for s in spans], _SPANS)], names=["doc_id", "lang_pred", "score", "spans"])

        pool, held = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), ~_LETTER)
                ids, letters = part.column("doc_id").to_pylist(), part.column("letters").to_pylist()
                if not model.langs:
                    pool += [[d, False, None, []] for d in ids]
                    continue
                score = model.scores(words)
                best, safe = sure(score, words, penalty)
                for i, doc in enumerate(ids):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    if safe[i]:
                        pool.append([doc, letters[i], None, [(0, b - a, int(best[i]))] if b > a else []])
                    else:
                        pool.append([doc, letters[i], score[a:b].copy(), []])
                        held += b - a
                if held >= pool_words or len(pool) >= 20_000:
                    yield packed(pool)
                    pool, held = [], 0
        if pool:
            yield packed(pool)

    return run


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 16.0, pool_words: int = 1_000_000) -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, spans`` (word numbers; start, stop, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of FEATURES values a language
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return own.mapInArrow(_label(shared, penalty, pool_words), "doc_id long, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return label(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
