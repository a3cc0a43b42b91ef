"""The pipeline's stages against brute force, on the smallest tables and on odd rows; the SQL of the numbered queries."""

import collections
import hashlib
import itertools
import math
import os
import re

import corpus_pipeline
import duckdb
import pytest
from test_llm_operators import quality, shingles, terms, words

from tessera.llm import registry

DATA = "/root/testdata/sf0.001"


def good(text):
    """Whether no quality rule rejects the text."""
    t = text or ""
    n, chars, symbols, dup, _, failed = quality(text)
    lines = sum(bool(words(x)) for x in t.split("\n"))
    return not (failed or 10 * symbols > n or 100 * len(re.findall("[A-Z]", t)) > 30 * chars or 2 * dup > lines or chars > 12 * n)


def without_templates(texts, depth=3, least=10):
    """The texts without the lines of recurring templates."""
    lines, family = [], {}
    for d, text in enumerate(texts):
        own = [x.strip(" ") for x in text.split("\n")] if text is not None else []
        drawn = []
        for at, line in enumerate(own):
            tokens = line.split(" ")
            if line:
                md5 = hashlib.md5(line.encode()).hexdigest()
                drawn.append((-math.log((int(md5[:8], 16) + 1) / 2**32) / len(tokens), md5))
            if line and len(tokens) >= 3:
                lines.append((d, at, ["<*>" if re.search(r"[0-9@]|://", x) else x for x in tokens]))
        family[d] = min(drawn)[1] if drawn else None

    def leaf(tokens):
        return len(tokens), tuple(tokens[:depth])

    leaves, stands = collections.defaultdict(set), collections.defaultdict(set)
    for d, _, tokens in lines:
        leaves[leaf(tokens)].add(family[d])
        for k, x in enumerate(tokens):
            stands[leaf(tokens), k, x].add(family[d])
    held, recurs = [], collections.defaultdict(set)
    for d, at, tokens in lines:
        key = leaf(tokens)
        if len(leaves[key]) < least:
            continue
        known = [x if x != "<*>" and (c := len(stands[key, k, x])) >= least and c >= 0.01 * len(leaves[key]) else "<*>" for k, x in enumerate(tokens)]
        names = {" ".join(x) for x in (tokens, known) if sum(y != "<*>" for y in x) >= 0.5 * len(x) and (x is tokens or any(y != "<*>" for y in x[depth:]))}
        for name in names:
            held.append((d, at, name))
            recurs[name].add(family[d])
    gone = {(d, at) for d, at, name in held if len(recurs[name]) >= least}
    return [text if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (d, at) not in gone) for d, text in enumerate(texts)]


def representatives(rows):
    """The rows that are the least of their class of near copies."""
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)), key=lambda i: rows[i].doc_id)
            root[y] = x
    return [r for i, r in enumerate(rows) if find(i) == i]


def clean(rows, bench):
    windows = collections.defaultdict(set)
    for text in bench:
        w = terms(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[s : s + 10])].add(tuple(w[s : s + 10]))

    def holds(text):
        w = terms(text)
        return any(tuple(w[i : i + n]) in own for n, own in windows.items() for i in range(len(w) - n + 1))

    return [r for r in rows if not holds(r.text)]


def plain(rows):
    return sorted(map(tuple, rows), key=str)


def test_pipeline(spark, docs):
    """Every stage, on what the one before has kept, against brute force."""
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    run = [(name, stages[name]) for name in ("quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "bpe")]
    assert run == corpus_pipeline.STAGES
    rows, now = docs.collect(), docs
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, stage in run:
        now = stage(spark, now, DATA).cache()
        got, before = now.collect(), len(rows)
        if name == "quality_rules":
            rows = [r for r in rows if good(r.text)]
        elif name == "line_dedup":
            left = without_templates([r.text for r in rows])
            assert sum(a != r.text for a, r in zip(left, rows, strict=True)) > 0
            rows = [type(r)(**(r.asDict() | {"text": t})) for r, t in zip(rows, left, strict=True)]
        elif name == "ngram_jaccard_join":
            rows = representatives(rows)
        elif name == "decontamination":
            rows = clean(rows, bench)
        else:
            assert sorted((r.doc_id, r.n_tokens, r.ids) for r in got) == sorted((r.doc_id, len(x), x) for r in rows for x in [tok.encode(r.text or "", add_special_tokens=False).ids])
            continue
        assert now.columns == docs.columns and plain(got) == plain(rows) and (name == "line_dedup" or len(rows) < before), name


def test_pipeline_odd(spark, odd, none):
    """Stages on odd rows: each row that should stay does, with all its columns; empty tables stay empty."""
    stages = dict(corpus_pipeline.STAGES)
    rows = odd.collect()
    assert plain(stages["quality_rules"](spark, odd, DATA).collect()) == plain(r for r in rows if good(r.text))
    assert plain(stages["line_dedup"](spark, odd, DATA).collect()) == plain(rows)
    assert plain(stages["decontamination"](spark, odd, DATA).collect()) == plain(clean(rows, [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]))
    kept = stages["ngram_jaccard_join"](spark, odd, DATA).collect()
    assert sorted((str(r.doc_id) for r in kept)) == sorted(map(str, (1, 2, 3, None, None, 4, 5, 7, 8, 9, 10, 11))) and set(kept) <= set(rows)
    assert stages["bpe"](spark, odd, DATA).count() == len(rows)
    now = none
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        assert now.count() == 0 and (name == "bpe" or now.columns == none.columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE_SQL[name]).fetchdf()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
