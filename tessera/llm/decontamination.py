"""Benchmark decontamination with a distributed positional inverted index.

Terms are lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII
characters.  A window is ``width`` consecutive terms of a benchmark item; an
item of fewer terms, but not none, is one window.

1. ``frequencies``: the number of documents with each benchmark term, over all
   documents.
2. ``anchors``: the ``rarest`` least frequent positions of each window.
3. ``postings``: (term, document, position) of the anchor terms, over all
   documents, stored once in the shared folder; phrase and proximity search
   both read it.  A posting shifted by its term's place in an item is the place
   where the item would begin; the anchors' lists are intersected by grouping
   on (document, item, begin), which pre-aggregates in each task.
4. Places that hold enough anchors are compared with the whole item, term by
   term, for exact phrases; proximity search instead reports items whose
   anchors occur near each other, in any alignment.

Tables that come from the benchmark are broadcast if their measured size is
within ``common.BROADCAST_BYTES``; beyond it they are joined by shuffling.  Null
or empty texts have no terms, however long texts are they count whole; items
with a null id or no terms are ignored; repeated items count once; items that
share an id count as one id.  Rows of documents are told apart by id and text,
so rows with null or shared ids are judged each by its own text, and repeated
rows alike.  Other columns, of any name, stay as they are; an empty table on
either side gives no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, settled, small

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(term: Column) -> Column:
    return F.when(F.length(term) == F.octet_length(term), F.lower(term)).otherwise(F.translate(term, _UPPER, _LOWER))


def raw_terms(text: Column) -> Column:
    """The terms of a text, in order, not yet lower-cased."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), lambda t: t != "")


def terms(text: Column) -> Column:
    return F.transform(raw_terms(text), lower_ascii)


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = benchmark.select(F.col(id_col).cast("string").alias("item_id"), terms(F.col(text_col)).alias("item_terms"))
    own = own.where(F.col("item_id").isNotNull() & (F.size("item_terms") > 0)).distinct()
    return own.select(F.xxhash64("item_id", "item_terms").alias("item"), "item_id", "item_terms", F.size("item_terms").alias("n"))


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and ``tag``, which tells rows apart that share an id."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tag"))


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    held = docs.select(F.explode(F.array_distinct(raw_terms(F.col("text")))).alias("raw")).select(lower_ascii(F.col("raw")).alias("term"))
    return held.join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def anchors(items: DataFrame, frequency: DataFrame, width: int, rarest: int) -> DataFrame:
    """``item, k, term, need``: position and term of each anchor, and the anchors that a match has at least."""
    placed = items.select("item", "n", F.posexplode("item_terms").alias("k", "term")).join(frequency, "term", "left").fillna(0, ["df"])
    spread = placed.select("*", F.explode(F.expr(f"sequence(greatest(0, k - {width - 1}), least(k, greatest(n - {width}, 0)))")).alias("s"))
    rank = F.row_number().over(W.partitionBy("item", "s").orderBy("df", "term", "k"))
    best = spread.select("item", "k", "term", "n", rank.alias("r")).where(F.col("r") <= rarest)
    return best.select("item", "k", "term", F.least("n", F.lit(rarest)).alias("need")).distinct()


def postings(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, tag, pos, item, k, need``: the positional postings of the anchor terms, by item."""
    placed = docs.select("doc_id", "tag", F.posexplode(raw_terms(F.col("text"))).alias("pos", "raw"))
    return placed.select("doc_id", "tag", "pos", lower_ascii(F.col("raw")).alias("term")).join(chosen, "term").drop("term")


def stored_postings(docs: DataFrame, items: DataFrame, width: int, rarest: int) -> DataFrame:
    """The index: ``postings`` of the anchors of ``items``, written to the shared folder."""
    vocabulary = settled(items.select(F.explode("item_terms").alias("term")).distinct(), "vocabulary")
    chosen = settled(anchors(items, frequencies(docs, small(vocabulary)), width, rarest), "anchors")
    return settled(postings(docs, small(chosen)), "postings")


def _phrase_places(found: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, tag, place``: where an item may begin, by its anchors."""
    placed = found.groupBy("doc_id", "tag", "item", (F.col("pos") - F.col("k")).alias("begin")).agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).where("c >= need")
    return placed.join(small(items), "item").select("doc_id", "tag", F.struct("item_id", "begin", "item_terms").alias("place"))


def _near_items(found: DataFrame, items: DataFrame, slop: int, share: float) -> DataFrame:
    """``doc_id, tag, item_id, n_anchors`` of items of whose anchors a ``share`` lies within ``slop`` places of one alignment."""
    band = F.floor((F.col("pos") - F.col("k")) / slop)
    banded = found.select("doc_id", "tag", "item", "k", F.explode(F.array(band, band + 1)).alias("band")).distinct()
    total = settled(found.select("item", "k").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("known")).join(small(items.select("item", "item_id")), "item"), "known-anchors")
    near = banded.groupBy("doc_id", "tag", "item", "band").agg(F.count(F.lit(1)).alias("c")).join(small(total), "item")
    near = near.where((F.col("c") >= 2) & (F.col("c") >= share * F.col("known") - 1e-9))
    return near.groupBy("doc_id", "tag", "item_id").agg(F.max("c").alias("n_anchors"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, rarest: int = 2, slop: int = 20, share: float = 0.8) -> DataFrame:
    """Per document row: ``doc_id, tag, n_words, matches, near``.

    ``matches`` is an array of (item_id, at), ``at`` the positions of the
    document's terms that lie in windows of that item; null without candidates.
    ``near`` is an array of the ids of items matched by proximity, as
    ``proximity_matches`` tells them; null without any.  ``tag`` is a hash of the
    text that tells rows apart that share an id.
    """
    own, items = documents_of(docs, id_col, text_col), settled(items_of(benchmark, item_col, item_text_col), "items")
    found = stored_postings(own, items, width, rarest)
    places = _phrase_places(found, items)
    nears = _near_items(found, items, slop, share).select("doc_id", "tag", F.lit(None).cast(places.schema["place"].dataType).alias("place"), F.col("item_id").alias("near"))
    listed = places.withColumn("near", F.lit(None).cast("string")).union(nears).groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"), F.collect_set("near").alias("near"))
    keys = listed.select(F.col("doc_id").alias("key"), F.col("tag").alias("key_tag"), F.when(F.size("places") > 0, F.col("places")).alias("places"), "near")
    joined = own.join(keys, own.doc_id.eqNullSafe(keys.key) & (own.tag == keys.key_tag), "left")
    joined = joined.select("doc_id", "tag", raw_terms(F.col("text")).alias("raw"), "places", "near")
    matches = F.expr(
        f"""filter(transform(places, p -> struct(p.item_id as item_id, flatten(transform(
              get(transform(array(transform(p.item_terms, (t, k) -> coalesce(get(own, p.begin + k) = t, false))), same ->
                filter(sequence(0, greatest(size(same) - {width}, 0)), s -> forall(slice(same, s + 1, {width}), x -> x))), 0),
              s -> sequence(p.begin + s, p.begin + s + least({width}, size(p.item_terms)) - 1))) as at)), m -> size(m.at) > 0)"""
    )
    lowered = joined.withColumn("own", F.when(F.col("places").isNotNull(), F.transform("raw", lower_ascii)))
    return lowered.select("doc_id", "tag", F.size("raw").cast("long").alias("n_words"), F.when(F.col("places").isNotNull(), matches).alias("matches"), "near")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, rarest: int = 2, slop: int = 20, share: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_anchors``: items of whose anchors a ``share`` occurs within ``slop`` places of one alignment.

    The terms between the anchors may differ and stretches may be inserted or
    left out; alignments are compared in overlapping bands of ``2 * slop``.
    Anchors that stand in no document don't count.
    """
    own, items = documents_of(docs, id_col, text_col), settled(items_of(benchmark, item_col, item_text_col), "items")
    near = _near_items(stored_postings(own, items, width, rarest), items, slop, share)
    return near.groupBy("doc_id", "item_id").agg(F.max("n_anchors").alias("n_anchors"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` (items matched by proximity)."""
    found = phrase_matches(docs, benchmark, **options)
    at = F.array_distinct(F.flatten(F.transform("matches", lambda m: m["at"])))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    n_near = F.greatest(F.coalesce(F.size("near"), F.lit(0)), F.lit(0)).cast("long")
    found = found.select("doc_id", "n_words", F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), n_near.alias("n_near"))
    found = found.withColumn("n_hit", F.greatest("n_hit", F.lit(0).cast("long")))
    return found.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of ``benchmark``; each row by its own text, whatever its id."""
    id_, tag = fresh(docs, "_id", "_tag")
    found = phrase_matches(docs, benchmark, id_col, text_col, **options)
    bad = small(settled(found.where(F.size("matches") > 0).select(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).distinct(), "contaminated"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_]) & (F.xxhash64(docs[text_col]) == bad[tag]), "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
with a as (select item_id::varchar item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
w as (select item_id, m, array_to_string(ws[s + 1:s + m], ' ') k from (select item_id, ws, least(10, len(ws)) m, unnest(range(greatest(len(ws) - 9, 1))) s from a where len(ws) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
g as (select doc_id, m, i, array_to_string(ws[i + 1:i + m], ' ') k from (select doc_id, ws, m, unnest(range(len(ws) - m + 1)) i from d, (select distinct m from w) where len(ws) >= m)),
h as (select distinct g.doc_id, g.i, g.m, w.item_id from g join w using (m, k)),
p as (select doc_id, count(distinct j) c from (select doc_id, i + unnest(range(m)) j from h) group by doc_id),
t as (select doc_id, count(*) c, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from h) group by doc_id),
it as (select distinct item_id, ws from a where item_id is not null and len(ws) > 0),
fr as (select term, count(*) df from (select unnest(list_distinct(ws)) term from d) group by term),
pl as (select item_id, ws, len(ws) n, unnest(range(len(ws))) k, unnest(ws) term from it),
sp as (select pl.*, coalesce(df, 0) df, unnest(range(greatest(0, k - 9), least(k, greatest(n - 10, 0)) + 1)) s from pl left join fr using (term)),
an as (select distinct item_id, ws, k, term from (select *, row_number() over (partition by item_id, ws, s order by df, term, k) r from sp) where r <= 2),
po as (select doc_id, pos, item_id, an.ws, k from (select doc_id, unnest(range(len(ws))) pos, unnest(ws) term from d) x join an using (term)),
kn as (select item_id, ws, count(distinct k) known from po group by item_id, ws),
nb as (select distinct doc_id, item_id, ws, k, unnest([floor((pos - k) / 20.0), floor((pos - k) / 20.0) + 1]) band from po),
ne as (select doc_id, count(distinct item_id) c from (select doc_id, item_id, ws, band, count(*) c from nb group by all) join kn using (item_id, ws) where c >= 2 and c >= 0.8 * known - 1e-9 group by doc_id)
select d.doc_id, len(d.ws)::bigint n_words, coalesce(p.c, 0)::bigint n_hit, coalesce(t.c, 0)::bigint n_items, sha256(coalesce(t.ids, '')) items_sha256, coalesce(p.c, 0) > 0 contaminated, coalesce(ne.c, 0)::bigint n_near
from d left join p using (doc_id) left join t using (doc_id) left join ne using (doc_id)
"""
