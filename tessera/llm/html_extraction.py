"""Main-text extraction by equivalence classes of page tokens.

A page's tokens are its structural elements, written as paths of labels (tag
and first class, digits masked).  Over the pages of one host each token has an
occurrence vector, the number of times it occurs in each page; tokens with
equal vectors make an equivalence class.  Vectors are never gathered: a vector
is known by the sum, over pages, of count times a hash of the page, which each
task adds up for itself, so a host with very many pages sends one row a token
and task.

A class is valid if its tokens occur once a page in ``support`` of a host's
pages and if it has several; the whole page is valid always.  Valid classes
nest by their paths into the template.  Running text (link text, menus, forms
and the like not counted) belongs to the innermost token of the template around
it; every token that has any of its own opens a slot, and the article is all
slots in page order, so no running text lies outside.  Only where the template
has an ``article`` or ``main`` with ``mass`` of all running text is that the one
slot.  Blocks of text that occur in ``support`` of a host's pages, in
``contents`` (of eight hash classes of page contents) at least, are template
text and no slot.  Hosts with fewer than ``least_pages`` pages, and pages
without their host's tokens, use the page's own tokens by the same rule.  A
host's template has at most ``1 / support`` times the tokens and blocks of its
average page, for each stands in that share of its pages, so no host's is large.

Within the slots, menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out, as whole elements: by tag, by
role, and by class and id, if every part of such a name is a word for furniture
or a neutral one (``related-posts``, but not ``related-work``).  An element
inside a line of text (``span``, ``b``, ``a`` and the like) is never left out for
its names, so no word of a sentence goes.  Character references are decoded,
white space inside a block becomes one space (so does ``br``), blocks are
trimmed, empty ones dropped, and the rest joined by one line feed in page order.

A null or empty page has empty text; a null url is a host of its own; rows with
equal ids are separate pages, and repeated rows have equal texts.  Pages of any
length are read whole, one at a time; an empty table gives none; other columns,
of any name, are left alone.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, small
from .text import chunks

_RAW = "script|style|textarea|title|noscript|iframe|template|svg|math|select|object|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)|<![^>]*>|<\?[^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br picture source audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STRUCTURE = frozenset("body article main section div nav aside header footer table form ul ol dl menu center td fieldset figure".split())
_OUT_TAGS = frozenset("head nav footer aside form button menu dialog fieldset".split())
#: Words that name furniture, and words that go with them in its names.
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidenav nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations comment comments disqus replies respond footer widget widgets "
    "toolbar login search".split()
)
_NEUTRAL = frozenset(
    "site page main global primary secondary top bottom left right post posts entry article articles blog story stories content inner outer wrap wrapper container box bar block section area zone slot unit rail "
    "column col row item items list link links group panel button buttons icon icons form thread reader user header".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
_PARTS = re.compile(r"[-_\s:]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _attributes(rest: str) -> dict[str, str]:
    if "=" not in rest and "hidden" not in rest:
        return {}
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}


def _left_out(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether the element is no part of an article; ``inside``: it lies in an article or main element."""
    if "hidden" in at:
        return True
    if tag in _INLINE:
        return False
    if tag in _OUT_TAGS or (tag == "header" and not inside) or at.get("aria-hidden") == "true" or at.get("role") in _OUT_ROLES:
        return True
    if tag in ("html", "body", "article", "main") and "comment" not in at.get("class", ""):
        return False
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        parts = [p.lower() for p in _PARTS.split(name) if p and not p.isdigit()]
        if parts and ((parts[-1] == "header" and not inside) or (any(p in _OUT_NAMES for p in parts) and all(p in _OUT_NAMES or p in _NEUTRAL for p in parts))):
            return True
    return False


class Page:
    """Blocks (text, path, length of the innermost left-out path) and tokens (path: count, running text) of a page."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int]] = []
        self.tokens: dict[str, list[int]] = {"": [1, 0]}
        self._text: list[str] = []
        self._links = 0
        # tag, path, longest left-out path, in a link, in an article
        self._stack: list[tuple[str, str, int, bool, bool]] = [("", "", 0, False, False)]
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(tag)
            else:
                self._open(tag, m["rest"])
        if at < len(source):
            self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        text = _html.unescape(text) if "&" in text else text
        self._text.append(text)
        if self._stack[-1][3]:
            self._links += len(text)

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        links, self._text, self._links = self._links, [], 0
        if not text:
            return
        _, path, out, _, _ = self._stack[-1]
        self.blocks.append((text, path, out))
        if not out:
            n = max(0, len(text) - links)
            self.tokens[""][1] += n
            while path:
                self.tokens[path][1] += n
                path = path.rpartition("/")[0]

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag not in _INLINE:
            self._flush()
        if tag in _VOID:
            return
        if tag not in _INLINE and self._stack[-1][0] == "p":
            self._stack.pop()
        elif tag in ("li", "td", "tr", "dd", "dt") and self._stack[-1][0] == tag:
            self._stack.pop()
        _, path, out, link, inside = self._stack[-1]
        at = _attributes(rest)
        bad = _left_out(tag, at, inside)
        if bad and tag in _INLINE:
            self._flush()
        if bad or tag in _STRUCTURE:
            name = (at.get("class") or "").split()
            label = _DIGITS.sub("0", tag + ("." + name[0] if name else "")).replace("/", "|")
            path = f"{path}/{label}"
            self.tokens.setdefault(path, [0, 0])[0] += 1
            if bad:
                out = len(path)
        self._stack.append((tag, path, out, link or tag == "a", inside or tag in ("article", "main")))

    def _close(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            own = self._stack[i][0]
            if own == tag:
                if self._stack[i][2] != self._stack[i - 1][2]:
                    self._flush()
                del self._stack[i:]
                return
            if tag in _INLINE and own not in _INLINE:
                return

    def own_slots(self, mass: float) -> list[str]:
        whole = self.tokens[""][1]
        best = max((p for p, (_, n) in self.tokens.items() if n >= mass * whole and rank(p)[0]), key=rank, default=None)
        if best is not None:
            return [best]
        own = {p: n for p, (_, n) in self.tokens.items()}
        for p, (_, n) in self.tokens.items():
            if p:
                own[p.rpartition("/")[0]] -= n
        return [p for p, n in own.items() if n > 0] or [""]

    def extract(self, slots: list[str], template: frozenset[int], key) -> str:
        def held(path: str, out: int) -> bool:
            return any((path == s or path.startswith(s + "/")) and out <= len(s) for s in slots)

        return "\n".join(t for t, path, out in self.blocks if held(path, out) and not (template and key(path, t) in template))


def rank(path: str) -> tuple:
    """Sort key of a slot: article before main before others, the outermost article, else the innermost element."""
    tags = [x.partition(".")[0] for x in path.split("/")]
    if tags[-1] in ("article", "main"):
        return (2 if tags[-1] == "article" else 1, -len(tags), path)
    return (0, len(tags), path)


def block_key(path: str, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the tokens and blocks of every host with their sums over the task's pages."""
    import xxhash

    total: dict[tuple, list[int]] = {}

    def packed() -> pa.RecordBatch:
        rows = [(host, path, block, *sums) for (host, path, block), sums in total.items()]
        names = ["host", "path", "block", "pages", "once", "vector", "mass", "content"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        total.clear()
        return out

    mask = (1 << 62) - 1
    for batch in batches:
        for part in chunks(batch, "html"):
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                page = Page(source or "")
                of = xxhash.xxh64_intdigest(source or "")
                for path, (n, mass) in page.tokens.items():
                    own = total.setdefault((host, path, None), [0, 0, 0, 0, 0])
                    own[0] += 1
                    own[1] += n == 1
                    own[2] = (own[2] + n * of) & mask
                    own[3] += mass
                # eight classes of content tell a text of many contents from one of many copies
                for path, text in {(p, t) for t, p, out in page.blocks if not out}:
                    total.setdefault((host, str(of & 7), block_key(path, text)), [0, 0, 0, 0, of & 7])[0] += 1
            if len(total) > 200_000:
                yield packed()
    yield packed()


def _extract(mass: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                out = []
                for source, slots, texts in zip(part.column("html").to_pylist(), part.column("slots").to_pylist(), part.column("texts").to_pylist(), strict=True):
                    page = Page(source or "")
                    if not any(s in page.tokens for s in slots or ()):
                        slots = page.own_slots(mass)
                    out.append(page.extract(slots, frozenset(texts or ()), block_key))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, support: float = 0.9, mass: float = 0.6, least_pages: int = 3, contents: int = 5) -> DataFrame:
    """Per host: ``host, slots, texts``.  ``pages`` has ``host, html``."""
    seen = settled(pages.select("host", "html").mapInArrow(_tokens, "host string, path string, block long, pages long, once long, vector long, mass long, content long"), "page-tokens")
    tokens = seen.where("block is null").groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("pages", "once", "mass")), (F.sum(F.col("vector").cast("decimal(38,0)")) % (1 << 62)).alias("vector"))
    hosts = tokens.where("path = ''").select("host", F.col("pages").alias("n"), F.col("mass").alias("whole"))
    valid = tokens.join(hosts, "host").where((F.col("n") >= least_pages) & (F.col("once") >= support * F.col("n")))
    parts = F.split("path", "/")
    tag = F.regexp_extract("path", r"([^/.]*)(?:\.[^/]*)?$", 1)
    grade = F.when(tag == "article", 2).when(tag == "main", 1)
    order = F.struct(grade.alias("grade"), (-F.size(parts)).alias("depth"), F.col("path").alias("path"))
    classes = valid.groupBy("host", "vector").agg(F.collect_list(F.struct("path", "mass", "whole")).alias("tokens"))
    classes = classes.select("host", F.filter("tokens", lambda x: (F.size("tokens") > 1) | (x["path"] == "")).alias("tokens"))
    nested = classes.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens")).select("host", "tokens", F.explode("tokens").alias("t"))
    inside = nested.select("host", "t.path", "t.mass", "t.whole").where((F.col("mass") >= mass * F.col("whole")) & grade.isNotNull())
    best = inside.groupBy("host").agg(F.array(F.max(order)["path"]).alias("best"))
    around = F.filter("tokens", lambda x: (F.col("t.path") != x["path"]) & F.startswith(F.col("t.path"), F.concat(x["path"], F.lit("/"))))
    around = F.array_max(F.transform(around, lambda x: F.struct(F.length(x["path"]).alias("n"), x["path"].alias("path"))))["path"]
    own = nested.select("host", F.explode(F.array(F.struct(F.col("t.path").alias("path"), F.col("t.mass").alias("mass")), F.struct(around.alias("path"), (-F.col("t.mass")).alias("mass")))).alias("t"))
    own = own.where("t.path is not null").groupBy("host", F.col("t.path").alias("path")).agg(F.sum("t.mass").alias("mass"))
    slots = own.groupBy("host").agg(F.sort_array(F.collect_list(F.when(F.col("mass") > 0, F.col("path")))).alias("slots"))
    slots = slots.join(best, "host", "left").select("host", F.coalesce("best", F.when(F.size("slots") > 0, F.col("slots")), F.array(F.lit(""))).alias("slots"))
    blocks = seen.where("block is not null").groupBy("host", "block").agg(F.sum("pages").alias("pages"), F.size(F.collect_set("content")).alias("contents")).where(F.col("contents") >= contents)
    texts = blocks.join(hosts, "host").where(F.col("pages") >= support * F.col("n")).groupBy("host").agg(F.collect_set("block").alias("texts"))
    return slots.join(texts, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.9, mass: float = 0.6, least_pages: int = 3, contents: int = 5) -> DataFrame:
    """Per row: ``page_id, url, text``.  The templates are broadcast if their measured size allows, else joined by host."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    known = small(settled(templates(own, support, mass, least_pages, contents), "templates"))
    joined = own.join(known, "host", "left").select("page_id", "url", "html", "slots", "texts")
    return joined.mapInArrow(_extract(mass), joined.select("page_id", "url", F.lit("").alias("text")).schema)


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
