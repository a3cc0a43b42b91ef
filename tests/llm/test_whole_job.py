"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
from test_llm_operators import window_removal

from tessera.llm import html_extraction, jaccard_join, language_id, suffix_dedup


def test_suffix_last_word(spark):
    """Passages of 50 words between documents that share 49 of them only."""
    draw, rows = random.Random(5), []
    for p in range(12):
        passage = [f"p{p}w{i}" for i in range(50)]
        for k in range(6):
            own = list(passage)
            if k in (0, 2, 4):
                own[-1 if p % 2 else 0] = f"p{p}other{k}"
            rows.append((10 * p + k, " ".join([f"a{draw.random()}", *own, f"z{draw.random()}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffix_dedup.drop_repeats(df).collect()), key=str)
    assert got == window_removal(rows, 50)


def test_html_two_slots(spark):
    """Text in siblings, without article or main: on a host of many pages, and on one of a single page."""
    page = '<html><body><div class="menu">m</div><div class="lead"><p>%s</p></div><div class="links"><a href="x">more %d</a></div><div class="body"><p>%s</p></div></body></html>'
    rows = [(i, f"http://two.slots/{i}", page % (f"lead {i} " * 3, i, f"body {i} " * 7)) for i in range(20)] + [(100, "http://one/", page % ("lead", 1, "body body body"))]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == f"{('lead 7 ' * 3).strip()}\n{('body 7 ' * 7).strip()}" and got[100] == "lead\nbody body body"


def test_html_classes(spark):
    """A token alone in its class is no template: its text is the page's own, and nothing of it is lost."""
    rows = [(i, f"http://odd/{i}", f'<body><div class="{"rare" if i == 3 else "body"}"><p>text {i}</p></div><div class="notes"><p>notes {i}</p></div></body>') for i in range(20)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}\nnotes {i}" for i in range(20))


def test_jaccard_recall(spark):
    """Pairs at the threshold in large buckets that Spark splits before they are compared."""
    draw, n, size = np.random.default_rng(3), 1500, jaccard_join.COORDINATES
    one = draw.integers(0, 3, (n, size), dtype=np.uint32)
    two = np.where(draw.random((n, size)) < 0.8, one, (one + 1) % 3)
    rows = [(2 * i + k, bytearray(s[i].tobytes())) for i in range(n) for k, s in enumerate((one, two))]
    edges = jaccard_join.candidate_edges(spark.createDataFrame(rows, "node long, sketch binary"), 0.8, 0.999, 4, 200).collect()
    root = dict(jaccard_join.forest(2 * n, np.array([(r.u, r.v) for r in edges])))
    found = sum(root.get(2 * i, 2 * i) == root.get(2 * i + 1) for i in range(n))
    assert found >= 0.998 * n, (found, n)


def test_language_script(spark):
    """A short span in another script is no word of a language without that script."""
    rows = [(i, t, lang) for i in range(20) for t, lang in (("the quick brown fox jumps over a lazy dog", "en"), ("съешь же ещё этих мягких французских булок", "ru"))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "the quick brown fox jumps булок the quick brown fox jumps over a lazy dog"
    got = language_id.label(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(s.start, s.stop, s.lang) for s in got.spans] == [(0, 5, "en"), (5, 6, "ru"), (6, 15, "en")]
