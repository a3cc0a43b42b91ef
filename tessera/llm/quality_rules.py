"""Quality rules as a short-circuit cascade of column expressions.

Every rule is a boolean column that is true where it rejects a text.  On a
sample (``sample_rows`` texts of ``sample_chars`` characters at most, the first
that a hash of the text picks; it decides nothing but the order) each rule's rejections are counted and its run time measured; the cascade is one
CASE expression that tries the rules by rejection per cost, best first, so a
later rule runs only on the rows that all earlier ones let pass.  The verdict
is the same in any order; only the work differs.

Null and empty texts have no words and are rejected by the word count.  Words
are runs of characters outside ``\\x20\\x09-\\x0D``.  Every row has a verdict of its
own: null ids, repeated rows and rows that share an id are judged alike, an
empty table gives an empty one, whole texts of any length count, and columns of
any name stay as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

_SPACE = " \t\n\x0b\f\r"
_SPLIT = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Text = Callable[[Column], Column]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), _SPACE, "")).cast("long")


def _n_of(text: Column, characters: str) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, characters, ""))).cast("long")


def n_symbols(text: Column) -> Column:
    return _n_of(text, SYMBOLS)


def n_capitals(text: Column) -> Column:
    return _n_of(text, CAPITALS)


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)


def n_dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, width: int = 3) -> Column:
    """Words inside ``width``-word windows that the text holds twice or more, the first one included.

    A window is first a 64-bit value, its hash above its position, in as few
    bits as the text's length needs; sorting puts windows of one hash side by
    side, so the work is n log n in the words of a text.  The hash may be short
    in a long text, so what it leaves is sorted once more by the words
    themselves: equal windows are told by their words alone, whatever the length.
    """

    whole, zero = F.lit(width).cast("long"), F.lit(0).cast("long")

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(whole, F.coalesce(F.get(p, i + 1) - x, whole)))
        return F.aggregate(step, zero, lambda a, x: a + x)

    def twins(s: Column, same) -> Column:
        return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

    def over(w: Column, bits: Column) -> Column:
        def key(x: Column, i: Column) -> Column:
            parts = [x, *(F.get(w, i + k) for k in range(1, width))]
            return F.call_function("shiftleft", F.xxhash64(*parts), bits).bitwiseOR(i.cast("long"))

        def by_hash(s: Column) -> Column:
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            hit = twins(s, lambda x, y: F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0)
            return F.transform(hit, lambda x: x.bitwiseAND(mask))

        def by_words(p: Column) -> Column:
            def spelt(x: Column) -> Column:
                own = [F.get(w, x.cast("int") + k) for k in range(width)]
                return F.named_struct(F.lit("words"), F.array(*own), F.lit("at"), x)

            spelled = F.sort_array(F.transform(p, spelt))
            return let(spelled, lambda s: F.transform(twins(s, lambda x, y: x["words"] == y["words"]), lambda x: x["at"]))

        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))), key)
        near = let(F.sort_array(windows), by_hash)
        return let(near, lambda p: F.when(F.size(p) == 0, zero).otherwise(let(F.sort_array(by_words(p)), covered)))

    return let(words(text), lambda w: let(F.length(F.bin(F.size(w).cast("long"))), lambda bits: over(w, bits)))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Text


BASE = (
    Rule("few_words", lambda t: n_words(t) < 50),
    Rule("repeated_words", lambda t: 100 * n_repeat_words(t) > 50 * n_words(t)),
)
MORE = (
    Rule("symbols", lambda t: 10 * n_symbols(t) > n_words(t)),
    Rule("capitals", lambda t: 100 * n_capitals(t) > 30 * word_chars(t)),
    Rule("dup_lines", lambda t: let(worded_lines(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("long_words", lambda t: word_chars(t) > 12 * n_words(t)),
)


def order(docs: DataFrame, rules: Iterable[Rule], text_col: str = "text", sample_rows: int = 1000, sample_chars: int = 20_000) -> list[Rule]:
    """The rules by sampled rejection per second, highest first; ties and an empty sample keep the given order.

    The sample has ``sample_rows`` texts of ``sample_chars`` characters at most, so the driver holds their product at most.
    """
    rules = list(rules)
    some = docs.select(F.col(text_col).alias("text")).where((F.pmod(F.xxhash64("text"), F.lit(64)) == 0) & (F.length("text") <= sample_chars)).limit(sample_rows).collect()
    if not some:
        return rules
    sample = docs.sparkSession.createDataFrame(some, "text string").coalesce(1)
    rated = []
    for rule in rules:
        began = time.perf_counter()
        hit = sample.agg(F.sum(F.when(rule.rejects(F.col("text")), 1).otherwise(0))).first()[0]
        rated.append((-(hit + 1) / (time.perf_counter() - began), len(rated), rule))
    return [r for *_, r in sorted(rated, key=lambda x: x[:2])]


def cascade(rules: Iterable[Rule], text: Column) -> Column:
    """True where no rule rejects; each rule runs only where the ones before it did not reject."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects(text), False) if out is None else out.when(rule.rejects(text), False)
    return F.lit(True) if out is None else out.otherwise(True)


def keep_good(docs: DataFrame, rules: Iterable[Rule] = BASE + MORE, text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects."""
    return docs.where(cascade(order(docs, rules, text_col, sample_rows), F.col(text_col)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Per row: the base counts, ``base_failed`` and ``kept``."""
    text = F.col("text")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rest = order(own, MORE, "text", sample_rows)
    counts = {f.__name__: f(text) for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}
    out = own.select("doc_id", "text", *(c.alias(k) for k, c in counts.items()))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select("doc_id", *counts, "base_failed", F.when(F.col("base_failed"), False).otherwise(cascade(rest, text)).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return report(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] k from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) >= 3)),
d as (select doc_id, i, count(*) over (partition by doc_id, k) c from g),
r as (select doc_id, count(distinct j) n from (select doc_id, i + unnest(range(3)) j from d where c > 1) group by doc_id),
l as (select doc_id, count(*) m, count(*) - count(distinct x) n from (select doc_id, unnest(string_split(t, chr(10))) x from w) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
f as (select doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint caps,
    coalesce(l.n, 0)::bigint n_dup_lines, coalesce(l.m, 0) m, coalesce(r.n, 0)::bigint n_repeat_words
    from w left join l using (doc_id) left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 100 * caps > 30 * word_chars
        or 2 * n_dup_lines > m or word_chars > 12 * n_words) kept
from f
"""
