"""Every operator against brute force, on a small table and on odd rows."""

import base64
import collections
import hashlib
import html
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, html_extraction, jaccard_join, language_id, line_dedup, quality_rules, substring_dedup, suffix_dedup, warc
from tessera.llm.components import components
from tessera.llm.text import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def window_removal(rows, width):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [1 << 28, 1 << 17, 1 << 10])
def test_substring_dedup(docs, odd, cells):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted((tuple(r) for r in substring_dedup.drop_repeated_windows(df, width=20, anchor=8, max_cells=cells).collect()), key=str)
        assert got == window_removal(rows, 20)


@pytest.mark.parametrize("cells", [1 << 28, 1 << 10])
def test_suffix_dedup(docs, odd, none, cells):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted((tuple(r) for r in suffix_dedup.drop_repeats(df, max_cells=cells).collect()), key=str)
        assert got == window_removal(rows, 50)
    assert suffix_dedup.drop_repeats(none).count() == 0 and suffix_dedup.repeats(none).count() == 0 and substring_dedup.drop_repeated_windows(none).count() == 0


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 3, "block": 2, "brute": 2}])
def test_jaccard_classes(spark, docs, options):
    text = " ".join(f"t{i}" for i in range(200))
    near = [(1000 + k, " ".join([*text.split()[:k], "new", *text.split()[k:]])) for k in range(0, 60)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([*near, (2001, None), (2002, ""), (2003, "a b"), (2004, "a  b"), (2005, "a b c")], "doc_id long, text string"))
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    root, links = {d: d for d in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.classes(df, **options).collect()}
    assert got == {d: (find(d), links[d]) for d in sets}
    kept = {r.doc_id for r in jaccard_join.keep_one(df).collect()}
    assert kept == {find(d) for d in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100}


def test_odd_classes(odd, none):
    got = collections.Counter((r.doc_id, r.class_id) for r in jaccard_join.classes(odd).collect())
    assert got[(1, 1)] == 2 and got[(6, 5)] == 1 and got[(2, 2)] == got[(3, 3)] == got[(4, 4)] == 1 and got[(None, None)] == 2
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and jaccard_join.classes(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, None, 4, 5, 7, 8, 9, 10, 11], key=str)


def test_language_viterbi(docs):
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    texts = [r.text for r in docs.limit(60).collect()]
    mixed = [f"{a[:200]} {b[:300]} {c[:100]}" for a, b, c in zip(texts, texts[7:], texts[13:], strict=False)]
    own = Words(pa.array(mixed), ~language_id._LETTER)
    score = model.scores(own)
    best, sure = language_id.sure(score, own, 16.0)
    parts = [score[own.first[i] : own.first[i + 1]] for i in range(len(mixed))]
    for i, (part, got) in enumerate(zip(parts, language_id.viterbi(parts, 16.0), strict=True)):
        now, back = part[0].astype(float), []
        for row in part[1:]:
            b = now.argmax()
            keep = now >= now[b] - 16
            back.append(np.where(keep, np.arange(len(now)), b))
            now = np.where(keep, now, now[b] - 16) + row
        path = [now.argmax()]
        for b in back[::-1]:
            path.append(b[path[-1]])
        assert path[::-1] == got.tolist()
        assert not sure[i] or set(path) == {best[i]}


def test_language(docs, odd, none):
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    got = {r.doc_id: r for r in language_id.label(docs, model).collect()}
    test = docs.where(held).collect()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in test) >= 0.97 * len(test)
    by = {r.doc_id: r for r in language_id.label(odd, model).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[9].lang_pred == "und" and by[2].score == 0 and by[10].lang_pred in model.langs
    assert language_id.label(none, model).count() == 0
    assert {r.lang_pred for r in language_id.label(odd, language_id.fit(none)).collect()} == {"und"}


def quality(text):
    w = words(text)
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality(docs, odd, none):
    for df in (docs, odd):
        want = sorted(((r.doc_id, *quality(r.text)) for r in df.collect()), key=str)
        got = quality_rules.report(df).collect()
        assert sorted((tuple(r)[:-1] for r in got), key=str) == want
        kept = sorted(str(r.doc_id) for r in got if r.kept)
        assert kept == sorted(str(r.doc_id) for r in quality_rules.keep_good(df).collect())
    assert quality_rules.report(none).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns


def test_quality_long(spark):
    """Millions of distinct words repeat nothing; three of them set again at the end do."""
    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3_000_000)), lambda i: i.cast("string")), " ")
    got = spark.range(1).select(F.concat(plain, F.lit(" 7 8 9")).alias("text")).select(quality_rules.n_repeat_words(F.col("text")).alias("n")).first()
    assert got.n == 6


def test_quality_order(docs):
    slow_useless = quality_rules.Rule("never", lambda t: F.length(F.repeat(t, 50)) < 0)
    quick = quality_rules.Rule("half", lambda t: F.length(t) % 2 == 0)
    assert [r.name for r in quality_rules.order(docs.repartition(4), [slow_useless, quick])][0] == "half"


def test_lines(spark, odd, none):
    body = [" ".join("x" * (i + j) + "y" for j in range(6)) for i in range(30)]
    base = [(i, f"First line of text {i}\nListed on day {i} at shop\n{body[i]}", None) for i in range(30)]
    base += [(100 + i, f"A copied text stays whole as its lines are one family {'and long ' * 9}\nListed on day 3 at shop", None) for i in range(30)]
    df = spark.createDataFrame(base, "doc_id long, text string, _gone string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(df, min_docs=10).collect()}
    assert got[5] == body[5] and got[100] == base[30][1].split("\n")[0]
    out = line_dedup.drop_lines(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert line_dedup.drop_lines(none).count() == 0


def test_line_rules(spark):
    """Equal lines always recur; a common opening alone is no template; variable fields are, beyond the leading tokens."""
    own = [f"body {' '.join(f'q{chr(97 + i % 26)}{chr(97 + j)}{i // 26 * "z"}' for j in range(20))}" for i in range(40)]
    names = [chr(97 + i % 26) * (3 + i // 26) for i in range(40)]
    texts = [f"It was raining\nIt was a {names[i]} {names[-i - 1]}\nPosted by user {names[i]} with thanks to all\n{own[i]}" for i in range(40)]
    got = line_dedup.drop_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {i: f"It was a {names[i]} {names[-i - 1]}\n{own[i]}" for i in range(40)}


def test_line_fields(spark):
    """The linear pattern masks what the plain one does."""
    plain = re.compile(r"[^ ]*([0-9@]|://)[^ ]*")
    lines = ["a1 b", " x@y  c:d e://f", "::// a: b:/ ://", "1", "no field", "é5é :5: /:/ a:b:c:// d", "@"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.m for r in df.select(line_dedup.masked(F.col("line")).alias("m")).collect()] == [plain.sub("<*>", x) for x in lines]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").union(spark.createDataFrame([(900, "beta GAMMA"), (900, "no id"), (901, None), (902, "?!"), (None, "alpha"), (903, "w3q w4q w5q w6q w7q w8q w9q w10q w11q w12q w13q")], "item_id long, text string"))
    items = [(str(r.item_id), terms(r.text)) for r in bench.collect() if r.item_id is not None]
    windows = {(i, tuple(w[s : s + 10])) for i, w in items if w for s in range(max(1, len(w) - 9))}
    for df in (docs, odd):
        want = []
        for r in df.collect():
            w, hit, ids = terms(r.text), set(), set()
            places = collections.defaultdict(list)
            for n in {len(x) for _, x in windows}:
                for i in range(len(w) - n + 1):
                    places[tuple(w[i : i + n])].append(i)
            for item, x in windows:
                for i in places.get(x, ()):
                    hit |= set(range(i, i + len(x)))
                    ids.add(item)
            want.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
        assert sorted((tuple(r)[:6] for r in decontamination.report(df, bench).collect()), key=str) == sorted(want, key=str)
    ids = [(None, "clean words only"), (None, "now beta gamma"), (3, "clean"), (7, "here Beta, gamma"), (7, "clean too"), (7, "clean too")]
    rows = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ids)], "doc_id long, text string, _tag int")
    assert sorted(r._tag for r in decontamination.drop_contaminated(rows, bench).collect()) == [0, 2, 4, 5]
    kept = decontamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and 1 not in {r.doc_id for r in kept.collect()} and 9 in {r.doc_id for r in kept.collect()}
    assert decontamination.report(none, bench).count() == 0 and decontamination.report(odd, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(30)))], "item_id long, text string")
    text = " ".join(f"u{i}" + (" between" if i % 6 == 5 else "") for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "u1 u2 other words"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.proximity_matches(df, bench).collect()] == [(1, "1")]


def test_bpe(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = ["ΑΣ ΣΑΣ İstanbul ǅ", "é Å ﬁ", "한국어 日本語", "😀👍🏽 it's 'S I'LL", "１２３ ⅷ ²", "a" * 3000 + "the" * 500]
    df = docs.select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 500, "text").distinct()).union(spark.createDataFrame([(600 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = bpe.encode(df, lexicon_words=500, summary_words=800)
    back = {r.doc_id: r.text for r in bpe.decode_ids(got).collect()}
    ids = {r.doc_id: r.ids for r in got.collect()}
    for r in df.collect():
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert ids[r.doc_id] == want and back[r.doc_id] == tok.decode(want, skip_special_tokens=False)
    assert bpe.encode(none).count() == 0
    rows = sorted(((r.doc_id, r.ids) for r in bpe.encode(odd, lexicon_words=50).collect()), key=str)
    assert rows == sorted(((r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()), key=str)


def test_transducer(tmp_path):
    import public_tokenizers

    vocabulary = bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    known = ["the", "then", "hen", "singing", "ringing", "ring", "é"]
    bpe.compile_lexicon(known, vocabulary, str(tmp_path / "t.bin"))
    t = bpe.Transducer(str(tmp_path / "t.bin"))
    found = t.find([w.encode() for w in [*known, "th", "thens", "x", ""]])
    assert [np.frombuffer(f, "<u4").tolist() for f in found[: len(known)]] == [vocabulary.merge(w) for w in known] and found[len(known) :] == [None] * 4
    assert len(t.final) < sum(len(w.encode()) for w in known)


def test_warc(spark):
    rows = [(5, "u\n é", None), (6, None, ""), (7, "x", "é" * 900_000), (8, "y", "é" * 900_000), (4, "y", "é" * 900_000), (9, "z", "<p>one"), (9, "z", "<p>one"), (None, "n", "<p>one"), (None, "m", "<p>alone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(pages, folder, chunk_bytes=1000)
    table = warc.read_archives(manifest, folder, chunk_bytes=1000)
    got = sorted((tuple(r) for r in warc.records(table).select("record", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((k for k, _, x in rows if (x or "").encode() == b and k is not None), default=None)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if first in (i, None) else ("revisit", first))))
    assert got == sorted(want, key=str)
    own = table.where("record = 4").orderBy("chunk").collect()
    assert len(own) == 1800 and b"".join(bytes(r.payload) for r in own) == ("é" * 900_000).encode() and max(r.size for r in own) <= 1000
    assert own[9].running_digest == base64.b32encode(hashlib.sha1(("é" * 5000).encode()).digest()).decode()
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_warc_foreign(spark):
    """Archives of other writers: other types, ids that are no numbers, HTTP heads inside, no digests."""
    import gzip
    from pyarrow import fs

    def member(kind, body, *more, urn="<urn:uuid:0-1>"):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", *more, f"Content-Length: {len(body)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\n\r\n<p>x"
    parts = [member("warcinfo", b"software: s"), member("response", http, "WARC-Target-URI:http://a/", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"<p>x").digest()).decode()), member("revisit", b"", "WARC-Refers-To: <urn:uuid:0-1>", urn="<urn:uuid:0-2>")]
    folder = warc.archive_folder(spark)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/other.warc.gz") as out:
        out.write(b"".join(parts))
    got = warc.records(warc.read_archives(spark.createDataFrame([(f"{root}/other.warc.gz",)], "path string"), folder, chunk_bytes=7)).orderBy("record_type").collect()
    assert [(r.record_type, r.record, r.payload_bytes, r.url) for r in got] == [("response", None, len(http), "http://a/"), ("revisit", None, 0, None), ("warcinfo", None, 11, None)]
    assert got[0].payload_digest == base64.b32encode(hashlib.sha1(http).digest()).decode()


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_html_words(spark):
    """Names of elements inside a line take no word away, nor do names that only begin like furniture."""
    page = '<body><article><p>Known as <span class="search-term">quark</span> and <b class="ad-hoc">boson</b>, <a class="nav-link" href="x">see</a>.</p><div class="related-work"><p>Earlier work %d</p></div><div class="related-posts"><p>More posts</p></div><div id="comment-list"><p>first!</p></div></article></body>'
    rows = [(i, f"http://w/{i}", page % i) for i in range(12)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].split("\n")[-1] == f"Earlier work {i}" for i in range(12))
    one = html_extraction.Page(page % 1).extract([""], frozenset(), html_extraction.block_key)
    assert one == "Known as quark and boson, see.\nEarlier work 1"


def test_html_sites(spark):
    """Pages made without article or main, by layouts whose text is known, against a plain search of their templates."""
    draw = np.random.default_rng(11)

    def prose():
        return " ".join(f"w{int(x)}" for x in draw.integers(0, 10**6, 30))

    layouts = {
        "plain": ('<body><div class="top"><nav><a href="a">home</a></nav></div><div class="text">{a}{b}</div><div class="foot">Made by us</div></body>', "ab"),
        "split": ('<body><table><tr><td class="lead">{a}</td><td class="ad-box"><p>Buy {x}</p></td></tr></table><section class="rest">{b}{c}</section><div class="footer"><p>{x}</p></div></body>', "abc"),
        "deep": ('<body><div id="w"><div class="col"><div class="box">{a}<div class="share-buttons"><p>tell {x}</p></div>{b}</div></div><div class="col2"><ul><li><a href="q">{x}</a></li></ul></div></div><form><p>{x}</p></form></body>', "ab"),
    }
    rows, want = [], {}
    for site, (layout, order) in layouts.items():
        for k in range(14):
            text = {c: prose() for c in "abcx"}
            rows.append((len(rows), f"http://{site}.example/{k}", layout.format(**{c: f"<p>{t}</p>" if c != "x" else t for c, t in text.items()})))
            want[len(want)] = "\n".join(text[c] for c in order)
    rows += [(len(rows), rows[3][1], rows[3][2]), (1000, "http://plain.example/long", layouts["plain"][0].format(a="<p>" + "long word " * 300_000 + "</p>", b="", x=""))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, slots int")
    got = {r.page_id: r.text for r in html_extraction.extract(df).collect()}
    assert {k: got[k] for k in want} == want and got[len(want)] == want[3] and got[1000] == ("long word " * 300_000).strip()


def test_html_template(spark):
    page = (
        '<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1><nav>x</nav></header><div class="cookie-notice">Cookies</div><div id="content"><p>Hello &amp;amp; <b>bo</b>ld<br>line &eacute;&nbsp;%d</p>'
        '<form><input><p>name</p></form><ul><li>one %d<li>two %d</ul><div class="comments"><p>great</p></div><script>var a = "</p>";</script><p>Bye %d<p>Standing text of the site</div><aside>side</aside><footer>foot</footer></body></html>'
    )
    rows = [(i, f"http://a.b/{i}", page % (i, i, i, i)) for i in range(20)] + [(100, None, None), (101, "x", "plain < text & <b>bold"), (102, "http://z/", '<p title="unclosed>a</p><p>b</p>'), (103, "http://z/", "")]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Hello &amp; bold line é 7\none 7\ntwo 7\nBye 7"
    assert got[100] == got[103] == "" and got[101] == "plain < text & bold" and got[102] == "a\nb"
    assert html_extraction.extract(spark.createDataFrame(rows[:0], "page_id long, url string, html string")).count() == 0
