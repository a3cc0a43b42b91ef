"""BPE encoding and decoding with a lexicon of frequent words in a minimal transducer.

Frequent words are counted over all texts: every task keeps a Misra-Gries
summary of ``summary_words`` counters, the summaries are added up by word, and
the ``lexicon_words`` best become the lexicon.  The lexicon is compiled, with
each word's ids as output, into a minimal acyclic transducer (equal suffixes
share states; the sums of arc weights on a word's path number it, and the
number finds its ids).  The file of the transducer goes to every executor with
``addFile`` (the driver's copy is removed when it ends), and its workers
memory-map it.  Words outside the lexicon are
merged exactly, in the order of merge ranks.

A text is cut at the vocabulary's special tokens, put into NFC, lower-cased
character by character, and split by the vocabulary's pattern; white space is
dropped.  Decoding joins the tokens of the ids with one space, special tokens
included.  Null is as empty: no ids and an empty decoded text.  Rows are encoded
each for itself: repeated rows, shared and null ids change nothing, texts of any
length are whole, an empty table gives an empty one, and columns of any name but
the two that are read are left alone.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import os
import shutil
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import chunks

#: Fixed values of the vocabulary's format: how its byte-level alphabet writes the 256 bytes.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHAR = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Space characters of the pattern that ``str.split`` treats in the same way; it also splits at 1C-1F, which the pattern does not.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\p{White_Space}+")


class Vocabulary:
    """Ids, merges and splitting rules of a word-end BPE vocabulary file."""

    #: Words of more bytes are merged with a heap.
    SHORT = 100

    def __init__(self, spec: str):
        j = json.loads(spec)
        self.ids: dict[str, int] = j["model"]["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(j["model"]["merges"])}
        self.end = j["model"]["end_of_word_suffix"] or ""
        self.pair_rank = {self.ids[a] << 32 | self.ids[b]: r for (a, b), r in self.rank.items()}
        self.made = [self.ids[a + b] for a, b in self.rank]
        self.byte_id, self.end_id = ([self.ids.get(BYTE_CHAR[b] + x) for b in range(256)] for x in ("", self.end))
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        names = self.ids | self.special
        self.names: list[str] = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        parts = j["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased without regard to its place in the word
                text = text.replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """The text's stretches without white space, and its special tokens (with a leading NUL)."""
        if self.cut is not None and "<" in text and self.cut.search(text):
            out: list[str] = []
            for i, part in enumerate(self.cut.split(text)):
                out += ["\0" + part] if i % 2 else self.pieces_of(part)
            return out
        return self.pieces_of(text)

    def pieces_of(self, text: str) -> list[str]:
        text = self.normal(text)
        return [x for x in _WHITE.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def merge(self, word: str) -> list[int]:
        """The word's ids by the merges, lowest rank first, leftmost first."""
        data = word.encode()
        if len(data) > self.SHORT:
            part = [BYTE_CHAR[b] for b in data]
            part[-1] += self.end
            return self._merge_long(part)
        own = [self.byte_id[b] for b in data]
        own[-1] = self.end_id[data[-1]]
        none, get = len(self.made), self.pair_rank.get
        ranks = [get(a << 32 | b, none) for a, b in zip(own, own[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            own[i] = self.made[least]
            del own[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(own[i] << 32 | own[i + 1], none)
            if i:
                ranks[i - 1] = get(own[i - 1] << 32 | own[i], none)
        return own

    def _merge_long(self, part: list[str]) -> list[int]:
        """The same with a heap, n log n in the word's bytes."""
        after = [*range(1, len(part)), -1]
        before = list(range(-1, len(part) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or part[i] != a or part[j] != b:
                continue  # one of the two has been merged meanwhile
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.rank.get((part[k], part[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[after[k]]))
        part = [p for p in part if p]
        return [self.ids[p] for p in part]


def compile_lexicon(words: Iterable[str], vocabulary: Vocabulary, path: str) -> None:
    """Write the minimal transducer of ``words`` to ``path``."""
    register: dict[tuple, int] = {}
    final: list[bool] = [False]
    arcs: list[dict[int, int]] = [{}]

    def share(state: int) -> int:
        key = (final[state], tuple(arcs[state].items()))
        return register.setdefault(key, state)

    path_states, last = [0], b""
    entries = sorted({w.encode() for w in words if w})
    for word in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            arcs[path_states[i - 1]][last[i - 1]] = share(path_states[i])
        del path_states[same + 1 :]
        for b in word[same:]:
            final.append(False)
            arcs.append({})
            arcs[path_states[-1]][b] = len(final) - 1
            path_states.append(len(final) - 1)
        final[path_states[-1]] = True
        last = word
    for i in range(len(last), 0, -1):
        arcs[path_states[i - 1]][last[i - 1]] = share(path_states[i])
    number, live, todo = {0: 0}, [0], [0]
    while todo:
        for t in arcs[todo.pop()].values():
            if t not in number:
                number[t] = len(live)
                live.append(t)
                todo.append(t)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        stack = [state]
        while stack:
            s = stack[-1]
            missing = [t for t in arcs[s].values() if t not in below]
            if missing:
                stack += missing
            else:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                stack.pop()
        return below[state]

    count(0)
    key, target, weight = [], [], []
    for s in live:
        passed = int(final[s])
        for b, t in sorted(arcs[s].items()):
            key.append(number[s] << 8 | b)
            target.append(number[t])
            weight.append(passed)
            passed += below[t]
    ids = [vocabulary.merge(w.decode()) for w in entries]
    size = np.array([len(x) for x in ids], np.int64)
    parts = [np.array(key, np.int64), np.array(target, np.int64), np.array(weight, np.int64), np.array([final[s] for s in live], np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.array([i for x in ids for i in x], np.int64)]
    with open(path, "wb") as f:
        f.write(np.array([len(p) for p in parts], np.int64).tobytes())
        for p in parts:
            f.write(p.tobytes())


class Transducer:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        flat = np.frombuffer(self._map, np.int64)
        cuts = np.cumsum(np.concatenate([[6], flat[:6]]))
        self.key, self.target, self.weight, self.final, self.offset, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The words' ids as little-endian 32-bit integers; None for a word outside the lexicon."""
        n = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(n) - n
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive, step = np.flatnonzero(n > 0), 0
        state[n == 0] = -1
        while len(alive) and len(self.key):
            key = state[alive] << 8 | data[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            state[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            number[alive] += self.weight[at]
            state[alive] = self.target[at]
            step += 1
            alive = alive[n[alive] > step]
        out: list[bytes | None] = [None] * len(words)
        if len(self.key):
            good = np.flatnonzero((state >= 0) & (self.final[np.maximum(state, 0)] == 1))
            ids = self.ids.astype("<u4")
            for i, k in zip(good.tolist(), number[good].tolist(), strict=True):
                out[i] = ids[self.offset[k] : self.offset[k + 1]].tobytes()
        return out


def _frequent(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, count = Vocabulary(shared.value), Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                for text in part.column("text").to_pylist():
                    if text:
                        count.update(vocabulary.pieces(text))
                if len(count) > 2 * size:
                    least = sorted(count.values(), reverse=True)[size]
                    count = Counter({w: n - least for w, n in count.items() if n > least})
        words: Counter = Counter()
        for piece, n in count.items():
            if n > 1 and piece[0] != "\0":
                for w in vocabulary.pattern.findall(piece):
                    words[w] += n
        top = words.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return run


class Encoder:
    """Pieces to ids: a bounded cache, then the transducer, then exact merges."""

    CACHE = 400_000

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.vocabulary, self.transducer, self.cache = vocabulary, transducer, {}

    def learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in set(pieces) if p not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > self.CACHE:
            self.cache.clear()
            new = list(set(pieces))
        words = [[] if p[0] == "\0" and p[1:] in self.vocabulary.special else self.vocabulary.pattern.findall(p) for p in new]
        flat = list({w for ws in words for w in ws})
        known = dict(zip(flat, self.transducer.find([w.encode() for w in flat]), strict=True))
        for w, ids in known.items():
            if ids is None:
                known[w] = pack(f"<{len(own := self.vocabulary.merge(w))}I", *own)
        for p, ws in zip(new, words, strict=True):
            self.cache[p] = b"".join(known[w] for w in ws) if ws else np.array([self.vocabulary.special[p[1:]]], "<u4").tobytes() if p[1:] in self.vocabulary.special else b""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.vocabulary.pieces(t) if t else [] for t in texts]
        self.learn({p for ps in pieces for p in ps})
        get = self.cache.__getitem__
        return [b"".join(map(get, ps)) for ps in pieces]


#: The encoder of this worker process: a worker runs many tasks of one job, and what it has learnt holds for all of them.
_HELD: dict[str, Encoder] = {}


def encoder_of(spec: str, file: str) -> Encoder:
    if file not in _HELD:
        _HELD.clear()
        _HELD[file] = Encoder(Vocabulary(spec), Transducer(SparkFiles.get(file)))
    return _HELD[file]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    return " ".join(map(vocabulary.names.__getitem__, ids.tolist()))


def _encode(shared, file: str, hashed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, file)
        vocabulary = encoder.vocabulary
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = encoder.encode(part.column("text").to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if hashed:
                    sha = [hashlib.sha256(x).hexdigest() for x in ids]
                    back = [hashlib.sha256(decode(np.frombuffer(x, "<u4"), vocabulary).encode()).hexdigest() for x in ids]
                    columns = [n, pa.array(sha, pa.string()), pa.array(back, pa.string())]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    columns, names = [n, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def _vocabulary_file(spark: SparkSession, path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _lexicon_file(spark: SparkSession, spec: str, words: list[str]) -> str:
    """The name under which executors find the transducer of ``words``; made once for the same words.

    The driver serves the file to executors as long as the session runs, so it
    goes when the driver ends.
    """
    key = hashlib.sha256("\0".join([spec, *sorted(words)]).encode()).hexdigest()[:24]
    file = f"lexicon-{key}.bin"
    if file not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
        folder = tempfile.mkdtemp(prefix="lexicon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        compile_lexicon(words, Vocabulary(spec), os.path.join(folder, file))
        spark.sparkContext.addFile(os.path.join(folder, file))
    return file


def _run(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, lexicon_words: int, summary_words: int, hashed: bool) -> DataFrame:
    spark = docs.sparkSession
    spec = _vocabulary_file(spark, tokenizer)
    shared = spark.sparkContext.broadcast(spec)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = own.select("text").mapInArrow(_frequent(shared, summary_words), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(lexicon_words).collect()
    file = _lexicon_file(spark, spec, [r.word for r in top])
    ids = "ids_sha256 string, decoded_sha256 string" if hashed else "ids array<int>"
    return own.mapInArrow(_encode(shared, file, hashed), f"doc_id long, n_tokens long, {ids}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, lexicon_words: int = 30_000, summary_words: int = 60_000) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids``.  ``tokenizer`` is the vocabulary file, by default the 49k word BPE."""
    return _run(docs, id_col, text_col, tokenizer, lexicon_words, summary_words, hashed=False)


def decode_ids(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Per row: ``doc_id, text``, the tokens of ``ids`` joined by one space (null: empty)."""
    shared = tokens.sparkSession.sparkContext.broadcast(_vocabulary_file(tokens.sparkSession, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            text = [decode(np.asarray(x or [], np.int64), vocabulary) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return _run(table(spark, sf_dir, "documents"), "doc_id", "text", None, 30_000, 60_000, hashed=True)
