"""Filter audit, hard negatives and HTML extraction: against brute force, on odd rows, and by held-out pages."""

import collections
import html
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ananas.llm import filter_audit, hard_negatives, html_extract
from tests.conftest import SF_SMALL
from tests.llm.test_edges import _docs

# --- filter audit

LONG = " ".join(f"w{i}" for i in range(30000)) + " Z$"
DOCS = [
    (1, "one two three", "en"), (2, "one two three", "de"), (2, "one two three", "en"), (2, "one two three", "en"),
    (3, None, "en"), (4, "", "en"), (5, "a a a a", None), (6, "ABC DEF", ""), (None, "one two three", "en"),
    (None, "", None), (7, "price $5", "fr"), (8, LONG, "fr"), (9, LONG, "en"), (10, " x　y Ä", "de"), (11, " \n\t", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, None), (9, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1)]
AUDIT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def _audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {k for k, bad in zip("ABCDE", [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)),
            d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs),
        ]) if bad}
        rows.append((lang or "", fails, d in good, d in toxic))
    out, removed = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = [r for r in own if f in r[1] and not any(r is x for x in left)]
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(gone), len(before), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed[part, f] += len(gone)
    return {(*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    docs = _docs(spark, DOCS).withColumn("mask", F.lit("x")).withColumn("h", F.lit(1)).withColumn("salt", F.lit(2))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("p"))
    got = [tuple(r[c] for c in AUDIT) for r in filter_audit.audit(docs, labels).collect()]
    assert len(got) == len(set(got)) == 600 * 4  # de, en, fr and the empty string
    assert set(got) == _audit(DOCS, LABELS)


def test_audit_empty_tables(spark):
    docs, labels = _docs(spark, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    got = filter_audit.audit(docs, labels).agg(F.sum("good_lost").alias("g"), F.sum("toxic_lost").alias("t"), F.count("*").alias("n")).first()
    assert (got.g, got.t, got.n) == (0, 0, 2400)


def test_removal_step_is_least_position(spark):
    """Any masks, any number of filters: the min-plus product is the first failed filter in the order."""
    rng = random.Random(5)
    masks = [("p", m, rng.randint(1, 9), 0, 0) for m in range(8)]
    got = filter_audit.removal_table(spark.createDataFrame(masks, "part string, mask int, n long, good long, toxic long"), "XYZ").collect()
    assert len(got) == 6 * 3
    for r in got:
        first = [next((s for s, f in enumerate(r.filter_order, 1) if m >> "XYZ".index(f) & 1), 4) for m in range(8)]
        assert r.removed == sum(n for (_, m, n, _, _), at in zip(masks, first) if at == r.step)
        assert r.kept == sum(n for (_, m, n, _, _), at in zip(masks, first) if at > r.step)


# --- hard negatives


def _mined(rows, low=30, high=90):
    """rows: (id, label, list) as integers, already quantised."""
    out = collections.Counter()
    for a, la, va in rows:
        if a % 100:
            continue
        dot = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in rows if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in dot if x[2] == la)[:5]:
            fit = sorted((t, i) for t, i, label in dot if label != la and low * -s <= 100 * -t <= high * -s)[:10]
            for rank, (t, i) in enumerate(fit, 1):
                out[a, p, rank, i, -s, -t] += 1
    return out


def _quantised(rows):
    keep = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        keep.append((i, label, [int(np.clip(np.floor(float(np.float32(x)) * 256), -(1 << 26), 1 << 26)) for x in v]))
    return keep


def _vectors(seed, n, dim, labels=3, scale=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    lab = rng.integers(0, labels, n)
    x = (centres[lab] * 0.8 + rng.normal(size=(n, dim))) * scale
    return [(int(i), int(k), [float(v) for v in np.float32(row)]) for i, (k, row) in enumerate(zip(lab, x))]


NAMES = "anchor_id positive_id rank negative_id positive_score negative_score".split()
ODD = [
    (200, None, [0.5] * 6), (300, 1, None), (400, 1, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (500, 1, [float("nan")] * 6), (600, 1, [float("inf")] + [0.1] * 5),
    (None, 1, [0.3] * 6), (700, 2, []), (701, 2, []), (702, 0, []), (800, 1, [0.2] * 4), (801, 1, [0.3] * 4), (802, 2, [0.2] * 4),
    (900, 1, [0.0] * 6), (-100, 1, [0.4] * 6), (-7, 9, [0.4] * 6), (1000, 7, [0.3] * 6), (1001, 0, [0.3] * 6), (1001, 0, [0.3] * 6), (1000, 7, [0.3] * 6),
]


@pytest.mark.parametrize("chunk, folder", [(1 << 21, 1 << 22), (200, 2000)])
def test_mine_against_brute_force(spark, monkeypatch, chunk, folder):
    rows = _vectors(1, 700, 6) + ODD + [(i, 1, [0.2] * 6) for i in range(2000, 2600)]  # 600 copies: ties by id
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"id": F.lit("a"), "v": F.lit(1), "key": F.lit(2), "run": F.lit(3)})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.quantised(df, "vec_id", label, "embedding")
    assert sorted((r.id, r.label, list(r.v)) for r in got.collect()) == sorted(_quantised(rows))
    build = hard_negatives.build_index
    monkeypatch.setattr(hard_negatives, "build_index", lambda rows: build(rows, sample_rows=50, folder_bytes=folder))
    got = hard_negatives.mine(got, F.col("id") % 100 == 0, chunk_bytes=chunk)
    want = _mined(_quantised(rows))
    assert collections.Counter(tuple(r[c] for c in NAMES) for r in got.collect()) == want and len(want) > 100


def test_mine_large_components(spark):
    """Sums beyond 2^53 are taken in 64-bit integers; beyond 2^26 a component counts as that."""
    rows = [(i, k, [x * 3e4 + 0.01 for x in v]) for i, k, v in _vectors(2, 300, 4, scale=1.0)] + [(1000, 1, [1e30, 0.0, 0.0, 1.0]), (1001, 1, [1e30, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = hard_negatives.mine_embeddings(df).collect()
    assert collections.Counter(tuple(r[c] for c in NAMES) for r in got) == _mined(_quantised(rows))


def test_mine_empty(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine_embeddings(spark.createDataFrame([], kind)).columns == NAMES
    assert hard_negatives.mine_embeddings(spark.createDataFrame([], kind)).count() == 0
    assert hard_negatives.mine_embeddings(spark.createDataFrame([(1, 1, [0.1]), (3, 1, [0.2])], kind)).count() == 0  # no anchor
    assert hard_negatives.mine_embeddings(spark.createDataFrame([(100, 1, []), (3, 1, [])], kind)).count() == 0  # no dimension


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2), (2, 5)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    """Every cell has a place of its own, and cells next to each other on the curve touch."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = hard_negatives.hilbert_keys(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_point():
    rng = np.random.default_rng(3)
    a, x = rng.integers(-300, 300, (20, 8)), rng.integers(-300, 300, (50, 8))
    least, most = hard_negatives.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all()
    corner = hard_negatives.bounds(a, x[:1], x[:1])  # a box of one point
    assert np.allclose(corner[0], scores[:, :1]) and np.allclose(corner[1], scores[:, :1])


def test_zone_maps_leave_blocks_unread(spark):
    """Far clusters: an anchor's positives are bounded away from the other labels' folders."""
    rows = [(i, i % 4, [4.0 * (i % 4 == d) + 0.01 * (i % 13) for d in range(4)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    index = hard_negatives.build_index(hard_negatives.quantised(df, "vec_id", F.col("label"), "embedding"), folder_bytes=4096)
    blocks = index.blocks.select("label", "n", "low", "high").collect()
    assert sum(b.n for b in blocks) == 4000 and all(b.n <= hard_negatives.BLOCK_ROWS for b in blocks)
    anchor = np.array([[1024 + 2 * (k == 0) for k in range(4)]]) * np.array([[1, 0, 0, 0]])
    _, most = hard_negatives.bounds(anchor, np.array([b.low for b in blocks]), np.array([b.high for b in blocks]))
    assert {b.label for b, m in zip(blocks, most[0]) if m > 1 << 19} == {0}


# --- HTML


@pytest.fixture(scope="module")
def pages():
    return duckdb.connect().execute(f"select page_id, url, html from '{SF_SMALL}/pages.parquet' order by 1").fetchall()


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.train(html_extract.labelled_pages([p[2] for p in pages]))


def _article(page):
    """The given pages' template, by a pattern: blocks of the one article element."""
    out = []
    for part in re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*)</article>", page, re.S)[1]):
        text = " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", part))).split())
        out += [text] if text else []
    return "\n\n".join(out)


def test_given_pages_by_pattern(spark, pages):
    got = {r.page_id: r for r in html_extract.learn_and_extract(spark.read.parquet(f"{SF_SMALL}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for i, url, page in pages:
        assert (got[i].text, got[i].url, got[i].n_chars) == (_article(page), url, len(_article(page)))


def _text(model, page):
    blocks = list(html_extract.leaf_blocks(page, frozenset(model.weights)))
    return [b.text for b, y in zip(blocks, model.labels(blocks)) if y]


UNSEEN = """<!doctype html><html><head><title>T</title><script>x = "<p>no</p>"</script><style>p{}</style></head><body>
<header class="site-header"><a href="/">My Site</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="cookie-banner"><p>We use cookies to serve you better.</p><button>OK</button></div>
<div class="wrapper">OPEN<h1>The title &amp; more</h1><p>First paragraph of the text, with a <a href="/x">link</a> in it,<br>and a second line.</p>
<div class="ad">Buy this now!</div><p>Second&nbsp;paragraph.</p><ul><li>item one of the list<li>item two of the list</ul><blockquote>Quoted words here.</blockquote>CLOSE
<aside class="sidebar"><h3>Related</h3><ul><li><a href=1>Another story</a></ul></aside></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I think that this is a great article, really well written and long.</p></div></section>
<form action="/s"><label>Search</label><input></form><footer>&copy; 2024 My Site</footer><noscript>Please enable scripts.</noscript></body></html>"""
BODY = ["The title & more", "First paragraph of the text, with a link in it, and a second line.", "Second paragraph.", "item one of the list", "item two of the list", "Quoted words here."]


@pytest.mark.parametrize("tag", ["<article>", "<main>", '<div class="post-content">', '<section id="story">'])
def test_unseen_templates(model, tag):
    page = UNSEEN.replace("OPEN", tag).replace("CLOSE", f"</{re.match('<([a-z]+)', tag)[1]}>")
    assert _text(model, page) == BODY


def test_held_out_templates(pages, model):
    """Pages of other seeds and other texts than the model has learnt from."""
    known, rng = frozenset(model.weights), random.Random(77)
    texts = [t for _, _, p in pages[:20] for t in _article(p).split("\n\n")]
    wrong = total = missed = 0
    for _ in range(200):
        blocks = list(html_extract.leaf_blocks(html_extract._dressed(rng, texts, ["Home", "About us", "© 2020 x", "Log in here", "More of this"])))
        own = [html_extract.Block(b.text, b.tag, b.around & known, b.linked, None) for b in blocks]
        for b, y in zip(blocks, model.labels(own)):
            wrong += y != (b.label or 0)
            missed += bool(b.label) and not y
            total += 1
    assert wrong / total < 0.03 and missed / total < 0.02


def test_blocks():
    def of(page):
        return [(b.tag, b.text) for b in html_extract.leaf_blocks(page)]

    assert of(None) == of("") == of("<p></p> <!-- x -->") == []
    assert of("a <b>b</b>c<br>d<p>e<p>f<div>g</div>h") == [("", "a bc d"), ("p", "e"), ("p", "f"), ("div", "g"), ("", "h")]
    assert of("<ul><li>1<li>2<ul><li>3</ul></ul>x") == [("li", "1"), ("li", "2"), ("li", "3"), ("", "x")]
    assert of("<table><tr><td>1<td>2<tr><td>3</table>") == [("td", "1"), ("td", "2"), ("td", "3")]
    assert of("1 < 2 &lt;p&gt; &#65;&amp &copy; &unknown; a&nbsp;b") == [("", "1 < 2 <p> A& © &unknown; a b")]
    assert of('<p title="a>b">c</p><P CLASS=x>d</P>') == [("p", "c"), ("p", "d")]
    assert of('<script>"</p>" <p>no</script>yes<style>x') == [("", "yes")]
    assert of("<svg><text>no</text></svg>yes<svg>open") == [("", "yesopen")]
    assert of("a<!-- <p> -->b<!doctype x>c<?php d?>e</ x>f<p") == [("", "abcef")]
    assert of("</div></p>a</section>b") == [("", "a"), ("", "b")]
    linked = list(html_extract.leaf_blocks("<p>ab<a href=x>cde</a></p><p>f</p>"))
    assert [b.linked for b in linked] == [3, 0]
    around = next(html_extract.leaf_blocks('<div class="siteMenu top-bar" role=navigation hidden><ul><li>x')).around
    assert {"t:div", "t:ul", "t:li", "c:site", "c:menu", "c:top", "c:bar", "c:navigation", "x:hidden"} == around


@pytest.mark.parametrize("page", ["<a <a " * 60000, "<" * 200000, '<a b="' * 60000, '<div class="x y">' * 60000 + "hi", "<svg>" * 60000, "</div>" * 60000, "<p>" + "word " * 400000, "<a =" + "'" * 200000, "<p>a" * 100000])
def test_hostile_pages_in_linear_time(page):
    sum(1 for _ in html_extract.leaf_blocks(page, frozenset(["t:div", "c:x"])))  # ends: quadratic time would not


def _score(model, features, labels):
    out = float(model.start[labels[0]])
    for a, b in zip(labels, labels[1:]):
        out += float(model.step[a, b])
    return out + sum(model.weights.get(f, 0.0) for x, y in zip(features, labels) if y for f in x)


def test_viterbi_against_enumeration(model):
    rng = random.Random(3)
    for _ in range(20):
        page = "".join(rng.choice(['<p>Some words of it.</p>', '<div class="ad">x</div>', "<li><a href=x>y</a>", "<h2>Related</h2>", "<p>one two three four five six seven eight nine ten", "<article>", "</article>", "<footer>z"]) for _ in range(9))
        blocks = list(html_extract.leaf_blocks(page, frozenset(model.weights)))
        features = [f + sorted(b.around) for f, b in zip(html_extract.text_features(blocks), blocks)]
        got = model.labels(blocks)
        if blocks:
            best = max(_score(model, features, y) for y in itertools.product((0, 1), repeat=len(blocks)))
            assert _score(model, features, got) == pytest.approx(best, abs=1e-9)


def test_training_raises_likelihood():
    """The labels' probability, by enumeration, is greater with the trained weights than with a shift of any of them."""
    rng = random.Random(1)
    pages = [[([rng.choice("ab"), rng.choice("cd")], rng.random() < 0.5) for _ in range(rng.randint(1, 4))] for _ in range(12)]
    pages = [[(f, int(y or "a" in f)) for f, y in p] for p in pages]
    fitted = html_extract.train(pages, ridge=0.5, steps=600)

    def objective(m):
        out = -0.25 * (sum(v * v for v in m.weights.values()) + (m.start**2).sum() + (m.step**2).sum())
        for p in pages:
            features, labels = [f for f, _ in p], [y for _, y in p]
            out += _score(m, features, labels) - np.logaddexp.reduce([_score(m, features, y) for y in itertools.product((0, 1), repeat=len(p))])
        return out

    top = objective(fitted)
    for f in fitted.weights:
        for d in (-0.05, 0.05):
            assert objective(html_extract.Model(fitted.weights | {f: fitted.weights[f] + d}, fitted.start, fitted.step)) <= top + 1e-6
    for d in (np.array([0.05, 0.0]), np.array([0.0, -0.05])):
        assert objective(html_extract.Model(fitted.weights, fitted.start + d, fitted.step)) <= top + 1e-6
        assert objective(html_extract.Model(fitted.weights, fitted.start, fitted.step + d[:, None])) <= top + 1e-6


def test_extract_odd_rows(spark, model):
    page = "<article><h1>Title of it</h1><p>A paragraph of the article, as usual.</p></article>"
    big = "<nav><a href=x>y</a></nav><article>" + "<p>Paragraph of a very long page, whole.</p>" * 20000 + "</article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (4, "x", big), (5, "y", "<nav><a href=x>only a menu</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit(1), "id": F.lit(2), "block": F.lit(3)})
    got = html_extract.extract(df, model).collect()
    want = "Title of it\n\nA paragraph of the article, as usual."
    assert collections.Counter((r.page_id, r.url, r.text if r.page_id != 4 else len(r.text), r.n_chars) for r in got) == collections.Counter([
        (1, "u", want, len(want)), (1, "u", want, len(want)), (2, None, "", 0), (3, "v", "", 0), (None, "w", want, len(want)),
        (4, "x", 39 * 20000 - 2, 39 * 20000 - 2), (5, "y", "", 0),
    ])
    blocks = html_extract.extract_blocks(df, model)
    assert blocks.filter("page_id = 4 and main").count() == 20000 and blocks.filter("page_id = 4 and not main").count() == 1
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_learn_from_nothing(spark):
    df = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_extract.learn_and_extract(df).collect()] == [(1, "", 0)]
    assert _text(html_extract.train(html_extract.labelled_pages([])), UNSEEN.replace("OPEN", "<article>").replace("CLOSE", "</article>"))[:2] == BODY[:2]
