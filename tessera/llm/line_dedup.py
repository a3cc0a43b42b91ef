"""Line deduplication with a log-template tree of fixed depth.

A line is trimmed and cut at single spaces; a field with a digit, ``@`` or
``://`` is variable from the start and becomes ``<*>``.  The tree's levels are
the number of tokens and the ``depth`` leading tokens.  Within a leaf, a token
is a constant of its position if it stands there in ``min_docs`` document
families and in a ``share`` of the leaf's families at least (so a position has
100 constants at most); all other tokens are variable fields.  Two templates
may hold a line: the line as it is, with the fields that are variable from the
start, and that of its leaf's constants, if one of these stands beyond the
leading tokens.  Either counts only if ``similarity`` of its tokens are
constant.  Templates that recur in ``min_docs`` families are dropped, with
every line that belongs to them, from every document.

A family is the documents that share one line, drawn by its digest with a
chance in proportion to its tokens: two documents are of one family with about
the probability that their lines, weighted by tokens, agree.  So copies of one
text, exact or near, count about once, and a text that was copied is not taken
for a page's standing lines, while short standing lines hardly ever make
different documents one family.  Documents that are standing lines for the
most part are near copies by this measure, and count as such.  Lines of fewer
than ``min_tokens`` tokens stay.  All counts run over all documents, and no
step depends on their order.

Texts keep their other lines as they are.  Null and empty texts stay as they
are, as do empty tables; rows with equal id and text lose the same lines, and
rows with a null id are treated as any other.  Very long texts are one row a
line.  A column of the table may have any name but the text column's: helper
columns take other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, settled, small

VARIABLE = "<*>"
#: A whole field that holds a digit, ``@`` or ``://``; matched from a field's start only, without going back.
_FIELD = r"(?<![^ ])[^ 0-9@:]*+(?::(?!//)[^ 0-9@:]*+)*+(?:[0-9@]|://)[^ ]*+"


def masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9@]|://"), F.regexp_replace(line, _FIELD, VARIABLE)).otherwise(line)


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _counted(line: Column) -> Column:
    return let(F.trim(line), lambda x: F.named_struct(F.lit("line"), x, F.lit("n"), _tokens(x)))


def _draw(own: Column) -> Column:
    """A line's place in the draw for its document's family: exponential, at the rate of its tokens."""

    def place(digest: Column) -> Column:
        even = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + 1) / F.lit(4294967296.0)
        return F.named_struct(F.lit("rank"), -F.ln(even) / own["n"], F.lit("digest"), digest)

    return let(F.md5(own["line"]), place)


def lines_of(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``doc_id, tag, family, at, line, n, leaf`` of every line with ``min_tokens`` tokens."""
    own = docs.select("doc_id", "tag", F.transform(F.split("text", "\n"), _counted).alias("lines"))
    family = F.xxhash64(F.array_min(F.transform(F.filter("lines", lambda x: x["line"] != ""), _draw))["digest"])
    own = own.select("doc_id", "tag", "lines", family.alias("family"))  # apart from the rows of lines, else it is drawn anew for each
    own = own.select("doc_id", "tag", "family", F.posexplode("lines").alias("at", "own")).select("doc_id", "tag", "family", "at", "own.line", "own.n")
    own = own.where((F.col("n") >= min_tokens) & (F.col("line") != ""))
    return own.withColumn("leaf", F.xxhash64("n", masked(F.substring_index("line", " ", depth))))


def recurring(docs: DataFrame, depth: int = 3, min_docs: int = 10, similarity: float = 0.5, min_tokens: int = 3, share: float = 0.01) -> DataFrame:
    """``doc_id, tag, at``: the lines that belong to recurring templates.  ``docs`` has ``doc_id, tag, text``."""
    lines = settled(lines_of(docs, depth, min_tokens), "lines")
    leaves = settled(lines.select("leaf", "family").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("families")).where(F.col("families") >= min_docs), "leaves")
    tokens = F.split(masked(F.col("line")), " ")
    held = settled(lines.join(small(leaves), "leaf").select("doc_id", "tag", "family", "at", "leaf", "families", tokens.alias("tokens")), "leaf-lines")
    placed = held.select("leaf", "family", "families", F.posexplode("tokens").alias("k", "token")).where(F.col("token") != VARIABLE).distinct()
    constant = placed.groupBy("leaf", "k", "token").agg(F.count(F.lit(1)).alias("c"), F.max("families").alias("families")).where((F.col("c") >= min_docs) & (F.col("c") >= share * F.col("families")))
    constants = settled(constant.groupBy("leaf").agg(F.collect_list(F.xxhash64("k", "token")).alias("constants")), "constants")
    known = F.transform("tokens", lambda t, k: F.when((t != VARIABLE) & F.array_contains("constants", F.xxhash64(k, t)), t).otherwise(VARIABLE))
    general = held.join(small(constants), "leaf", "left").select("doc_id", "tag", "family", "at", "tokens", F.coalesce(known, F.array().cast("array<string>")).alias("known"))

    def fixed(template: Column) -> Column:
        return F.size(F.filter(template, lambda t: t != VARIABLE))

    deep = F.exists(F.slice("known", depth + 1, F.greatest(F.size("known"), F.lit(1))), lambda t: t != VARIABLE)
    enough = similarity * F.size("tokens")
    own = [F.when(fixed(F.col("tokens")) >= enough, F.array_join("tokens", " ")), F.when((fixed(F.col("known")) >= enough) & deep, F.array_join("known", " "))]
    named = F.transform(F.array_distinct(F.array_compact(F.array(*own))), lambda t: F.sha2(t, 256))
    general = settled(general.select("doc_id", "tag", "family", "at", F.explode(named).alias("template")), "templates")
    often = general.select("template", "family").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_docs).select("template")
    return general.join(small(settled(often, "often")), "template").select("doc_id", "tag", "at")


def without(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the sorted places ``gone``, by the stretches between them."""
    opens = F.concat(F.array(F.lit(-1)), gone)
    closes = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(opens, closes, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def marked(docs: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, str]:
    """``docs`` with a column (its name comes second) of the sorted places of the lines to drop, null if there are none."""
    id_, tag, gone = fresh(docs, "_id", "_tag", "_gone")
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text")).where("text is not null")
    found = recurring(own, **options).groupBy(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).agg(F.sort_array(F.collect_set("at")).alias(gone))
    return docs.join(found, docs[id_col].eqNullSafe(found[id_]) & (F.xxhash64(docs[text_col]) == found[tag]), "left").drop(id_, tag), gone


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``; the lines of recurring templates are gone from the texts."""
    out, gone = marked(docs, id_col, text_col, options)
    kept = F.array_join(without(F.split(F.col(text_col), "\n"), F.col(gone)), "\n")
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out, gone = marked(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", {})
    lines = F.split("text", "\n")
    kept = F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(without(lines, F.col(gone)), "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return out.select("doc_id", count.alias("n_lines"), dropped.alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


OP5_SQL = r"""
with u as (select doc_id, generate_subscripts(ls, 1) i, unnest(ls) line from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null)),
t as (select doc_id, i, trim(line, ' ') line, len(string_split(trim(line, ' '), ' ')) n from u),
y as (select doc_id, arg_min(md5(line), -ln((('0x' || substr(md5(line), 1, 8))::bigint + 1) / 4294967296.0) / n) family from t where line <> '' group by doc_id),
f as (select doc_id, i, family, n, string_split(case when regexp_matches(line, '[0-9@]|://') then regexp_replace(line, '[^ ]*([0-9@]|://)[^ ]*', '<*>', 'g') else line end, ' ') tk from t join y using (doc_id) where n >= 3),
f2 as (select *, array_to_string(tk[1:3], ' ') lead, len(list_filter(tk, lambda x: x <> '<*>')) fixed from f),
v as (select n, lead, count(distinct family) families from f2 group by n, lead having count(distinct family) >= 10),
h as (select f2.*, families from f2 join v using (n, lead)),
p as (select distinct n, lead, families, family, generate_subscripts(tk, 1) k, unnest(tk) token from h),
c as (select n, lead, k, token from p where token <> '<*>' group by n, lead, k, token, families having count(*) >= 10 and count(*) >= 0.01 * families),
e as (select doc_id, i, n, lead, family, generate_subscripts(tk, 1) k, unnest(tk) token from h),
g as (select e.doc_id, e.i, e.n, e.family, string_agg(case when c.token is not null then e.token else '<*>' end, ' ' order by e.k) template,
      count(c.token) fixed, coalesce(max(case when c.token is not null then e.k end), 0) deepest
      from e left join c on e.n = c.n and e.lead = c.lead and e.k = c.k and e.token = c.token group by e.doc_id, e.i, e.n, e.family),
b as (select doc_id, i, family, template from g where fixed >= 0.5 * n and deepest > 3 union select doc_id, i, family, array_to_string(tk, ' ') from h where fixed >= 0.5 * n),
o as (select template from b group by template having count(distinct family) >= 10),
d as (select distinct doc_id, i from b join o using (template)),
k as (select u.doc_id, count(*) n_lines, count(d.i) n_dropped, string_agg(u.line, chr(10) order by u.i) filter (where d.i is null) t from u left join d using (doc_id, i) group by u.doc_id)
select x.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_dropped, 0)::bigint n_dropped, sha256(coalesce(t, '')) kept_sha256 from documents x left join k using (doc_id)
"""
