"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, by operator."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ananas.llm import decontaminate, langid, licenses, mixing, ngram_join, pq_dedup, secrets, suffix_dedup, toxicity, warc
from ananas.llm.shared import components

# columns whose names the operators use themselves
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row long, n string, words string, th long, id string, size string, rank double"


def _docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 7, "x", "y", 1, "z", "w", 0.5) for r in rows]
    return spark.createDataFrame(full, CLASH)


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60000))
P13 = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
EDGE = [
    (1, P13 + " tail of the text"),
    (2, "Something else. " + P13.upper() + "! And more words here to stand around it."),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (None, P13 + " tail of the text"),
    (6, LONG),
    (7, LONG),
    (8, "short one"),
    (8, "short one"),
    (9, "Éa " * 40 + "password = 'abcdef0123456789'"),
    (None, None),
]


def _bag(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


# --- decontamination

def _hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    win = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            win[tuple(w[k : k + 13])].add(str(i))
    out = collections.Counter()
    for d, t in rows:
        w, own = low(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if found := win.get(tuple(w[k : k + n])):
                    own |= found
                    hit[k : k + n] = [True] * n
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out[d, len(w), sum(hit), len(own), sha, sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    return out


DECONT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [(1, P13), (2, P13 + " pi rho"), (2, P13 + " pi rho"), (10, "short one"), (3, None), (4, "..."), (None, "word1 and1"), (5, "word5")]


@pytest.mark.parametrize("limit", [1 << 25, 600])
def test_decontaminate(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit(1))
    got = decontaminate.decontaminate(_docs(spark, EDGE), items, limit=limit)
    assert _bag(got, *DECONT) == _hits(EDGE, ITEMS)


def test_decontaminate_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = _docs(spark, EDGE)
    assert all(not r.contaminated for r in decontaminate.decontaminate(docs, items).collect())
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


# --- licences

def test_licenses(spark):
    rows = [
        (1, "Text here. Released under the MIT License. More\nSPDX-License-Identifier: Apache-2.0\nend"),
        (2, "You may obtain a copy of the License at once. You may obtain a copy of the License at"),
        (3, "You may not use this file except in compliance with the License.\nSome words.\nYou may obtain a copy of the License at\n"),
        (3, "You may obtain a copy of the License at\nYou may not use this file except in compliance with the License."),
        (4, None), (5, ""), (None, "LICENSED under   CC BY-NC 4.0."), (None, "..."),
    ]
    got = _bag(licenses.scan_licenses(_docs(spark, rows)), "doc_id", "n_sentences", "n_known", "sequence", "licenses")
    assert got == collections.Counter([
        (1, 5, 2, ",4,,15,", "Apache-2.0,MIT"), (2, 2, 1, ",3,", ""), (3, 3, 2, ",2,,3,", "Apache-2.0"), (3, 2, 2, ",3,,2,", ""),
        (4, 0, 0, "", ""), (5, 0, 0, "", ""), (None, 1, 1, ",10,", "CC-BY-NC-4.0"), (None, 0, 0, "", ""),
    ])
    assert licenses.scan_licenses(_docs(spark, rows).limit(0)).collect() == []


MIT = """MIT License

Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License"); you may not use
 * this file except in compliance with the License. You may obtain a copy of the
 * License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """# Copyright (c) 2019, Some Body
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
"""


def test_licenses_verbatim(spark):
    wrapped = {1: MIT, 2: APACHE, 3: GPL, 4: BSD, 5: MIT.replace("\n", "\r\n"), 6: GPL.replace("    ", ";; ")}
    flat = {10 * k: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")) for k, t in wrapped.items() if k in (1, 3)}
    rows = [*wrapped.items(), *flat.items(), (7, GPL.replace("GNU General", "GNU Affero General")), (8, "x: y\n\n" + GPL + MIT + GPL),
            (9, "Copyright (c) 2001 A\n(c) 2002 B\n" + GPL)]
    got = {r.doc_id: (r.sequence, r.licenses) for r in licenses.scan_licenses(_docs(spark, rows)).collect()}
    assert got == {
        1: (",19,,6,", "MIT"), 2: (",18,,2,,3,", "Apache-2.0"), 3: (",20,,21,", "GPL-3.0"), 4: (",17,,13,", "BSD,proprietary"),
        5: (",19,,6,", "MIT"), 6: (",20,,21,", "GPL-3.0"), 10: (",19,,6,", "MIT"), 30: (",20,,21,", "GPL-3.0"),
        7: (",21,", ""), 8: (",20,,21,,19,,6,,20,,21,", "GPL-3.0,MIT"), 9: (",20,,21,", "GPL-3.0"),
    }


# --- secrets

def test_secret_spans(spark):
    key = "Zx9Qv7Lm2Rt8Kp4Ws6Yb1NcD3F"
    rows = [
        (1, "a Token: 'abcdefghijkl' b"), (2, "password: token = abcdefghijklmn"), (3, "AKIAABCDEFGHIJKLMN AKIA12"),
        (4, "é deadbeefdeadbeef deadbeef"), (5, None), (6, ""), (None, f"the value {key} was there"), (7, "plainwordsthatarelongandordinary again"),
    ]
    train = [(100 + i, f"the words of text number {i} are ordinary_identifiers and longer plainwords thatarelong withoutsecrets") for i in range(60)]
    docs = _docs(spark, rows + train)
    got = {(r.doc_id, r.spans, r.n_markov) for r in secrets.find_secrets(docs).filter("doc_id < 100 or doc_id is null").collect()}
    assert got == {
        (1, "assign:2:22", 0), (2, "", 0), (3, "access:0:18", 0), (4, "hex:2:18", 0), (5, "", 0), (6, "", 0), (None, f"markov:10:{10 + len(key)}", 1), (7, "", 0),
    }
    model = secrets.train(secrets.labelled_strings(docs))
    out = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs, model).filter("doc_id < 8").collect()}
    assert out[1] == ("a [SECRET]' b", 13) and out[5][0] is None and out[7][0] == rows[-1][1]
    assert secrets.find_secrets(docs.limit(0)).collect() == []


# --- mixing

def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "en", ["a", "b", "c", "d", None][i % 7 % 5]) for i in range(900)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "e"), (None, "x y z", "en", "b"), (5, "dup row", "en", "b"), (5, "dup row", "en", "b")]
    docs = _docs(spark, rows)
    got = mixing.mix(docs, range_rows=16).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    targets = {s: v[0].target for s, v in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for s, v in by.items():
        assert v[0].source_size == sum(r.size for r in v) and targets[s] <= 2 * v[0].source_size
        assert abs(sum(r.taken for r in v) - targets[s]) <= max((r.size for r in v), default=0)
    key = lambda rs: sorted((str(r.doc_id), r.taken) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(5), range_rows=16).collect())
    assert mixing.mix(docs.limit(0)).collect() == []


# --- toxicity

def test_toxicity_counterfactual(spark):
    """Group names that go with label 1 in the sample must carry no score once swaps are penalised."""
    rows, labels = [], []
    for i in range(400):
        bad, group = i % 4 == 0, ["muslim", "christian"][(i % 4 == 0) ^ (i % 7 == 0)]
        rows.append((i, f"the {group} people came to town {'you idiot' if bad else 'in peace'} number"))
        labels.append((i, int(bad)))
    rows += [(900, "the muslim people came"), (901, "the christian people came"), (902, "you idiot"), (903, None), (904, ""), (None, "you idiot")]
    docs, lab = _docs(spark, rows), spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.learn_and_score(docs, lab).collect()}
    assert len(got) == len(rows)
    assert abs(got[900].score - got[901].score) < 0.1 and got[900].predicted == 0
    assert got[902].predicted == 1 and got[None].predicted == 1 and got[903].score == got[904].score
    none = toxicity.learn_and_score(docs, lab.limit(0)).collect()
    assert len(none) == len(rows) and all(r.score == 0.5 for r in none)
    assert toxicity.learn_and_score(docs.limit(0), lab).collect() == []


# --- n-gram join

def _jaccard(rows, shingle=4, percent=85):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                up[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return collections.Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def _near_rows(seed=5):
    """Families of texts with a few words changed, chains whose ends don't link, and a common passage."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 400)}"
    common = " ".join(word() for _ in range(25))
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(int(rng.integers(5, 120)))]
        for k in range(int(rng.integers(1, 7))):
            t = list(base)
            for _ in range(k):
                t[int(rng.integers(0, len(t)))] = word()
            rows.append((i, " ".join(t) + (" " + common if i % 3 == 0 else "")))
            i += 1
    chain = [word() for _ in range(80)]
    for k in range(12):
        chain = chain[2:] + [word(), word()]
        rows.append((i + (k * 7) % 12, " ".join(chain)))
    return rows


def test_small_points_of_long_texts():
    """Counts stop at three, what lies beyond is the rest: the bound is never below the overlap."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 64, 3_000_000, dtype=np.uint64)
    sets = [h, h[:2_900_000], h[:900], h[300:1000], h[:40], h[35:70], h[:1]]
    points = ngram_join.unpacked_small([ngram_join.small_point(x) for x in sets])
    rest = [len(x) - int(p.sum()) for x, p in zip(sets, points)]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            o = len(np.intersect1d(x, y))
            assert np.minimum(points[i], points[j]).sum() + min(rest[i], rest[j]) >= o
            assert i != j or np.minimum(points[i], points[j]).sum() + rest[i] == o


def test_overlap_in_pieces():
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"W{x}" if x % 3 else f"w{x}\té" for x in rng.integers(0, 12, n)).encode()
    for n in (0, 2, 3, 4, 50, 900):
        x, y = text(n), text(50) + b" " + text(n)
        assert ngram_join.overlap(x, y, piece=7) == ngram_join.overlap(x, y)
    assert ngram_join.overlap(b"A b", b"a  B") == (1, 1, 1) and ngram_join.overlap(b"", b" ") == (0, 0, 0)


def test_long_pair(spark):
    """Two texts of 200,000 words that differ in a few, and one that is a little too far."""
    words = [f"w{(k * 7919) % 100003}x{k % 17}" for k in range(200_000)]
    near, far = list(words), list(words)
    near[::60], far[::40] = ["n"] * len(near[::60]), ["f"] * len(far[::40])  # J of 0.875 and 0.818
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (4, "one two three four five")]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(_docs(spark, rows)).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 4}


@pytest.mark.parametrize("block, few", [(8, 2), (4, 16)])
def test_ngram_join_across_blocks(spark, monkeypatch, block, few):
    """A family of near misses with some links among them, in buckets of many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = np.random.default_rng(block)
    base, rows = [f"b{k}" for k in range(90)], []
    for i in range(70):
        t = list(base)
        for k in rng.choice(90, int(rng.integers(1, 6)), replace=False):
            t[k] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(t)))
    got = _bag(ngram_join.jaccard_components(_docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == _jaccard(rows) and 1 < len({k[2] for k in got}) < 70


@pytest.mark.parametrize("best", [False, True])
def test_pairs_are_made_where_they_meet_first(spark, monkeypatch, best):
    """Near copies and near misses share dozens of rare shingles; a pair is not made again in the bucket of each."""
    rng, rows = np.random.default_rng(9), []
    for f in range(20):
        base = [f"f{f}w{k}" for k in range(int(rng.integers(100, 500)))]
        for k in range(6):
            t = list(base)
            for i in rng.choice(len(t), k + 1, replace=False):
                t[i] = f"x{k}y{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(t)))
    docs = _docs(spark, rows).select("doc_id", "text")
    sets = ngram_join.document_sets(docs, ngram_join.cell_counts(docs))
    buckets = ngram_join.bucket_rows(sets, 85)
    labels = spark.createDataFrame([(r.row, r.doc_id % 2) for r in sets.collect()], "row long, label long")
    words = [t.split() for _, t in rows]
    full = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in words]
    link = lambda x, y: 100 * len(full[x] & full[y]) >= 85 * len(full[x] | full[y])
    for label in (None, labels):
        with monkeypatch.context() as m:
            m.setattr(type(docs), "distinct", lambda self: self)
            pairs = ngram_join._candidates(buckets, label, sets, 85, best)
        ids = {r.row: r.doc_id for r in sets.collect()}
        held = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")  # a pair's buckets lie in many tasks
        try:
            made = [tuple(sorted((ids[r.a], ids[r.b]))) for r in pairs.collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", held)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(made) <= 1.2 * len(set(made)) and len(set(made)) > 50
        want = {(x, y) for x in ids.values() for y in ids.values() if x < y and link(x, y) and (label is None or x % 2 != y % 2)}
        assert len(want) > 50 and (best or want <= set(made))


def test_earlier_buckets_of_a_pair():
    """A pair is left out only for a bucket that both rows were in; rows without any are no match."""
    lists = pa.array([[7, 8], [], [], [8], [0], [9, 7]], pa.list_(pa.int64()))
    earlier = ngram_join.padded(lists.slice(0, 6), 3)
    z, n = np.zeros(6, dtype=np.int64), np.full(6, 9)
    small = [ngram_join.small_point(np.arange(9, dtype=np.uint64))] * 6
    a, b = ngram_join._block_pairs(z, z > 0, np.arange(6), n, z, np.arange(6), z, small, 85, False, earlier)
    assert {(i, j) for i in range(6) for j in range(i + 1, 6)} - set(zip(a.tolist(), b.tolist())) == {(0, 3), (0, 5)}
    assert [r.tolist() for r in ngram_join.padded(lists.slice(3, 3), 2)[0]] == [[8, 0], [0, 0], [9, 7]]


def test_ngram_join(spark):
    rows = _near_rows() + [(i + 1000 if i is not None else None, t) for i, t in EDGE] + [(1500, "a b"), (1501, "A b"), (1502, "a")]
    got = _bag(ngram_join.jaccard_components(_docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == _jaccard(rows)
    assert ngram_join.jaccard_components(_docs(spark, rows).limit(0)).collect() == []


def test_keep_first(spark):
    rows = [(2, P13), (1, P13), (3, P13 + "!"), (4, None), (4, None), (5, ""), (None, P13)]
    want = collections.Counter([(1, P13), (3, P13 + "!"), (4, None), (5, "")])
    docs = _docs(spark, rows).withColumns({"__id": F.lit(1), "__th": F.lit("q"), "_id": F.lit(2), "TH_": F.lit(3)})
    got = ngram_join.keep_first(docs)
    assert got.columns == docs.columns and _bag(got, "doc_id", "text") == want
    assert {(r["__id"], r["__th"], r["id"], r["th"], r["_id"]) for r in got.collect()} == {(1, "q", "z", 1, 2)}
    assert _bag(ngram_join.keep_first(docs.select("doc_id", "text")), "doc_id", "text") == want


def test_stages_leave_clashing_columns_alone(spark):
    names = "__size __u u size source_ whole p ranges cut_at cut __id __th id th _id _th".split()
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(20 + i)), "en", "ab"[i % 2]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(777 + k) for k, c in enumerate(names)})
    plan = mixing.mix_plan(corpus_pipeline.written(mixing.measure(docs), "sized"))
    mixed = mixing.copies_of(docs, plan)
    gone = docs.filter("doc_id < 3").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    left = corpus_pipeline._kept(docs, gone)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == list(range(3, 30))
    assert mixed.columns == [*docs.columns, "copies"] and mixed.count() == 30
    for out in (mixed, left):
        assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(777 + k for k in range(len(names)))}
    own = {r.doc_id: r.copies for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    assert {r.doc_id: r.copies for r in mixed.collect()} == own and len(set(own.values())) > 1


def _points(rng, rows=300):
    sets = [np.unique(rng.integers(0, 1 << 64, int(rng.integers(3, 200)), dtype=np.uint64)) for _ in range(rows // 2)]
    for x in list(sets):
        y = x.copy()
        y[rng.random(len(y)) < rng.choice([0.02, 0.05, 0.1, 0.3])] = rng.integers(0, 1 << 64, dtype=np.uint64)
        sets.append(np.unique(y))
    n = np.array([len(x) for x in sets], dtype=np.int64)
    small = [ngram_join.small_point(x) for x in sets]
    points = ngram_join.unpacked_small(small)
    rest = n - points.sum(axis=1, dtype=np.int64)
    bound = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64) + np.minimum(rest[:, None], rest[None])
    need = ngram_join.least_overlap(n[:, None], n[None])
    fits = np.minimum(n[:, None], n[None]) * 100 >= 85 * np.maximum(n[:, None], n[None])
    return sets, n, small, points, bound, need, fits


def test_tree_pairs_lose_no_pair():
    sets, n, _, points, bound, need, fits = _points(np.random.default_rng(1))
    labels = np.arange(len(n)) % 200
    ok = (bound >= need) & fits & (labels[:, None] != labels[None])
    got = [(min(i, j), max(i, j), o) for a, b, bound_ in ngram_join.tree_pairs(points, n, labels) for i, j, o in zip(a, b, bound_)]
    assert sorted(got) == [(i, j, bound[i, j]) for i, j in zip(*np.nonzero(np.triu(ok, 1)))]


@pytest.mark.parametrize("few", [1, 16])
def test_block_pairs(monkeypatch, few):
    """Blocks one after the other, with their places and sides, by brute force; the best pairs too."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = np.random.default_rng(few)
    sets, n, small, points, bound, need, fits = _points(rng, 240)
    order = np.lexsort((n, np.arange(len(n)) % 12))  # a set and its copy in one block
    key = order % 12
    row, label, side, pos = order + 1000, order % 150, rng.integers(0, 2, len(n)), np.minimum(rng.integers(0, 8, len(n)), n[order] - 1)
    across = key % 2 == 0
    own = [small[i] for i in order]
    want = set()
    for i in range(len(key)):
        for j in range(i):
            a, b = order[i], order[j]
            if key[i] == key[j] and label[i] != label[j] and fits[a, b] and bound[a, b] >= need[a, b] and (side[i] != side[j]) == across[i]:
                if min(n[a] - pos[i], n[b] - pos[j]) >= need[a, b]:
                    want.add((min(row[i], row[j]), max(row[i], row[j]), key[i], bound[a, b] - need[a, b]))
    a, b = ngram_join._block_pairs(key, across, row, n[order], pos, label, side, own, 85, False)
    assert sorted(zip(a, b)) == sorted({w[:2] for w in want}) and len(want) > 20
    a, b = ngram_join._block_pairs(key, across, row, n[order], pos, label, side, own, 85, True)
    best = set(zip(a, b))
    assert best <= {w[:2] for w in want}
    for k in set(key):
        for x in row.tolist():
            rooms = [(w[3], w[:2] in best) for w in want if w[2] == k and x in w[:2]]
            assert not rooms or any(kept for room, kept in rooms if room == max(rooms)[0])


# --- embeddings

def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows, i = [], 0
    for b in base:
        for k in range(4):
            rows.append((i, [float(c) for c in b + 0.05 * k * rng.normal(size=16)], i % 2))
            i += 1
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, rows[0][1], None), (0, rows[0][1], 0), (None, rows[0][1], 0), (908, [float("inf")] * 16, 0)]
    got = pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit(1)), block=16)
    want_links = []
    for a, (_, x, la) in enumerate(rows):
        n = 0
        for b, (_, y, lb) in enumerate(rows):
            if a != b and la is not None and la == lb and x and y and len(x) == len(y) and None not in x and None not in y and np.isfinite(x).all() and np.isfinite(y).all():
                lx, ly = np.linalg.norm(x), np.linalg.norm(y)
                n += bool(lx and ly and np.dot(x, y) / lx / ly >= 0.93)
        want_links.append(n)
    found = got.collect()
    assert len(found) == len(rows)
    assert _bag(got, "vec_id", "n_links") == collections.Counter((r[0], n) for r, n in zip(rows, want_links))
    by = {r.vec_id: r for r in found}
    assert by[906].component_id == 905 and by[905].kept and not by[906].kept and by[None].component_id == 0 and by[907].component_id == 907
    assert pq_dedup.near_duplicates(got.select("vec_id", F.array(F.lit(1.0)).alias("embedding"), F.lit(1).alias("label")).limit(0)).collect() == []


def test_recall_of_probes(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, base + 0.25 * rng.normal(size=base.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sum(r.n_links for r in pq_dedup.near_duplicates(df).collect())
    assert 0.9 * link.sum() <= got <= link.sum()


@pytest.mark.parametrize("dims", [64, 128])
def test_recall_at_most_lists(dims):
    """Pairs just above the threshold, of vectors the index wasn't fitted on, with as many lists as there can be."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    index = pq_dedup.fit(unit(rng.normal(size=(pq_dedup.SAMPLE_ROWS, dims))), pq_dedup.MOST_LISTS * pq_dedup.LIST_ROWS)
    assert len(index.centroids) == pq_dedup.MOST_LISTS and index.probes == pq_dedup.PROBES
    a = unit(rng.normal(size=(20000, dims)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(axis=1)[:, None] * a)
    c = rng.uniform(pq_dedup.COSINE + 1e-6, pq_dedup.COSINE + 0.01, len(a))[:, None]
    b = c * a + np.sqrt(1 - c * c) * side
    near = [pq_dedup.nearest(x, index.centroids, index.probes) for x in (a, b)]
    found = np.zeros(len(a), dtype=bool)
    for q, x, visits, home in ((a, b, near[0], near[1][:, 0]), (b, a, near[1], near[0][:, 0])):
        code, error = index.encode(x, home)
        for k in range(len(index.centroids)):
            own = np.flatnonzero((home == k) & (visits == k).any(axis=1))
            told = [index.estimate(q[i : i + 1], code[i : i + 1], k)[0, 0] for i in own]
            found[own] |= np.array(told) + error[own] >= pq_dedup.COSINE - 1e-9
    print(f"recall at {dims} dimensions: {found.mean():.4f}")
    assert found.mean() >= 0.95


# --- languages

def test_language(spark):
    en = "the quick brown fox jumps over the lazy dog while people are walking through the town"
    es = "el perro corre por la calle mientras los niños juegan con una pelota en el parque grande"
    ru = "собака бежит по улице пока дети играют в парке с мячом и смеются"
    rows = [(i, t + f" {i}", lang) for i, (t, lang) in enumerate([(en, "en"), (es, "es"), (ru, "ru")] * 20)]
    rows += [(900, None, "en"), (901, "12 34 !", "en"), (902, "", None), (903, en + " " + es + " " + ru + " " + en, None), (None, es, None), (904, "日本語", None), (905, "nul\0 the town and people", None)]
    docs = _docs(spark, rows)
    model = langid.train(docs.filter("doc_id < 60").select("text", "lang"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:60])
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    n, m, k = len(en.split()), len(es.split()), len(ru.split())
    assert got[903].spans == f"en:0:{n - 1},es:{n}:{n + m - 1},ru:{n + m}:{n + m + k - 1},en:{n + m + k}:{2 * n + m + k - 1}"
    assert got[None].lang_pred == "es" and got[904].lang_pred in model.languages
    assert langid.learn_and_identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
    assert langid.learn_and_identify(docs.limit(0)).collect() == []


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(9)
    size = np.array([3, 1, 5, 4])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    scores = rng.normal(size=(size.sum(), 3)) * 3
    best = langid.viterbi(scores, begin, size, switch=1.5)
    for b, n in zip(begin, size):
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        value = [scores[np.arange(b, b + n), p].sum() - 1.5 * (np.diff(p) != 0).sum() for p in paths]
        assert (best[b : b + n] == paths[int(np.argmax(value))]).all()


# --- WARC

def test_warc_round_trip(spark):
    big = "<html>" + "é" * 700 + "</html>"
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (5, "http://b/", big), (2, None, "small"), (3, "u", "small"), (4, "u", None), (None, "n", big), (6, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    records, payloads = warc.write_archive(pages)
    assert payloads.count() == len({(h or "") for _, _, h in rows})
    got = _bag(warc.archive_index(records, payloads), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    n = len(big.encode())
    assert got == collections.Counter(
        [(1, n, sha(big), "revisit", 5), (5, n, sha(big), "revisit", 5), (5, n, sha(big), "response", None), (None, n, sha(big), "revisit", 5)]
        + [(i, len((h or "").encode()), sha(h), "response", None) for i, _, h in rows if h != big]
    )
    back = warc.read_archive(records, payloads).select(warc.record_bytes().alias("b"), "header", "body").collect()
    for r in back:
        head, _, body = bytes(r.b).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body == bytes(r.body) + b"\r\n\r\n"
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(r.body)
    bodies = collections.Counter(bytes(r.body).decode() for r in back)
    assert bodies == collections.Counter({big: 1, "small": 2, "": 5})
    empty = warc.write_archive(pages.limit(0))
    assert warc.archive_index(*empty).collect() == []
    with pytest.raises(Exception, match="differs from its address"):
        warc.archive_index(records, payloads.withColumn("payload", F.lit(b"other"))).collect()


def test_warc_index_rebuilds_records(spark):
    pages = spark.createDataFrame([(1, "u", "small"), (2, "v", "x" * 2000), (3, "w", "x" * 2000)], "page_id long, url string, html string")
    records, payloads = warc.write_archive(pages)
    assert warc.archive_index(records, payloads).count() == 3
    cut = records.withColumn("header", F.encode(F.replace(F.decode("header", "UTF-8"), F.lit("Content-Length: 2000"), F.lit("Content-Length: 1999")), "UTF-8"))
    with pytest.raises(Exception, match="body differs from its header"):
        warc.archive_index(cut, payloads).collect()
    # length and digests are those of the joined bytes, whatever columns the store has besides
    assert {r.payload_bytes for r in warc.archive_index(records, payloads.withColumn("length", F.lit(7).cast("long"))).collect()} == {5, 2000}


# --- suffix dedup

def _repeats(rows, match=50):
    first = {}
    order = lambda d: float("inf") if d is None else d
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for k in range(len(b) - match + 1):
            w = b[k : k + match]
            first[w] = min(first.get(w, float("inf")), order(d))
    out = collections.Counter()
    for d, b in texts:
        hit = np.zeros(len(b) + match + 1, dtype=int)
        for k in range(len(b) - match + 1):
            if first[b[k : k + match]] < order(d):
                hit[k] += 1
                hit[k + match] -= 1
        cover = np.cumsum(hit)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~cover]) if b else b""
        out[d, len(b), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


REPEAT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 7))))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = [(i, text(int(rng.integers(0, 60))) + (" " + shared[i % 4][i % 9 :] if i % 3 else "") + text(int(rng.integers(0, 20)))) for i in range(120)]
    rows += [(200 + i, "a" * (40 + 7 * i)) for i in range(6)] + [(300, "ab" * 200), (301, "ba" * 90)]
    rows += [(i + 1000 if i is not None else None, t) for i, t in EDGE if t != LONG] + [(1006, LONG[:30000]), (1007, "x" + LONG[:30000])]
    rows += [(50, text(40)), (50, rows[50][1])]
    got = _bag(suffix_dedup.remove_repeats(_docs(spark, rows)), *REPEAT)
    assert got == _repeats(rows)
    assert suffix_dedup.remove_repeats(_docs(spark, rows).limit(0)).collect() == []


def test_long_text_comes_in_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    data = "".join(map(chr, rng.integers(97, 123, 5_000_000)))
    whole = set()
    for _, place, _ in suffix_dedup._anchor_rows(pa.array([data]), 50, 24):
        whole |= set(place.tolist())
    b = np.frombuffer(data.encode(), dtype=np.uint8)
    _, place, _ = suffix_dedup.anchors(b, np.array([0, len(b)]))
    assert whole == set(place.tolist())


# --- components, pipeline

def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 960)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(up)}


def test_pipeline_stages_on_edges(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (EDGE, EDGE[:0]):
        docs = _docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            extra = ["copies"] if name == "source_mix" else []
            assert out.columns == docs.columns + extra, name
            assert out.count() <= docs.count()
            docs = corpus_pipeline.written(out, name) if not extra else out


def _planted(rng):
    """Documents with exact and near copies, benchmark passages, secrets and texts without a letter."""
    word = lambda: f"{rng.choice(['al', 'ber', 'cor', 'den'])}{rng.choice(['an', 'en', 'or', 'is'])}{chr(97 + rng.integers(0, 26))}{chr(97 + rng.integers(0, 26))}"
    text = lambda n: [word() for _ in range(n)]
    item = text(20)
    rows = [(i, " ".join(text(int(rng.integers(30, 90))))) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    for i in range(5, 10):
        w = rows[i][1].split()
        w[len(w) // 2 : len(w) // 2 + 1] = ["changed"]
        rows.append((100 + i, " ".join(w)))
    rows += [(200, " ".join(item + text(30))), (201, " ".join(text(400) + item[:13])), (202, " ".join(item[:12] + text(20)))]
    rows += [(300, " ".join(text(40)) + " password = 'abcdefghijklmnop' " + " ".join(text(5))), (301, " ".join(text(40)) + " deadbeefdeadbeefdeadbeef")]
    rows += [(400, None), (401, ""), (402, "123 ... 456")]
    return [(i, t, "en", "abc"[i % 3]) for i, t in rows], [(1, " ".join(item)), (2, " ".join(text(15)))]


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    """Each stage's decisions, on what its predecessor kept, by a plain version of its rule."""
    rows, items = _planted(np.random.default_rng(12))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        got = {r.doc_id: r for r in docs.collect()}
        left = list(texts.items())
        if name == "language_id":
            want = {i: t for i, t in left if t and re.search("[a-z]", t)}
        elif name == "ngram_jaccard_join":
            want = {least: texts[least] for _, _, least in _jaccard(left, 5, 80)}
            assert 5 <= len(left) - len(want) <= 10  # the exact copies, and near ones of long texts
        elif name == "benchmark_decontamination":
            gone = {k[0] for k in _hits(left, items) if k[-1]}
            assert gone == {200}  # 201: 13 of 413 words, 202: no window
            want = {i: t for i, t in left if i not in gone}
        elif name == "secret_scan":
            want = {i: t.replace("password = 'abcdefghijklmnop", "[SECRET]").replace("deadbeefdeadbeefdeadbeef", "[SECRET]") for i, t in left}
            assert sum(want[i] != t for i, t in left) == 2
            assert all(r.n_chars == len(r.text) for r in got.values())
        else:
            sizes = {i: len(t.split()) for i, t in left}
            total = sum(sizes.values())
            for source in "abc":
                own = sum(n for i, n in sizes.items() if "abc"[i % 3] == source)
                taken = sum(sizes[i] * r.copies for i, r in got.items() if r.source == source)
                assert taken <= 2 * own
            assert abs(sum(sizes[i] * r.copies for i, r in got.items()) - 1.5 * total) <= 3 * max(sizes.values())
            assert all(r.copies in (1, 2) for r in got.values()) and len(got) == docs.count()
            want = {i: texts[i] for i in got}
        assert {i: r.text for i, r in got.items()} == want, name
        texts = want


def test_very_long_texts(spark):
    """A text of 1.5 MB with something at its end, for the operators that no other test gives one."""
    body = " ".join(f"word{i % 977} and{i % 31} the" for i in range(100_000))
    rows = [(1, body + "\nLicensed under the Apache License, Version 2.0.\npassword = 'abcdefghijklmnop'"), (2, "short and the word"), (3, None)]
    docs = _docs(spark, rows)
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    at = rows[0][1].index("password")
    assert f"assign:{at}:" in got[1].spans and got[1].n_assign == 1
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {1: len(rows[0][1].split()), 2: 4, 3: 0}
    assert {r.doc_id for r in licenses.scan_licenses(docs).collect()} == {1, 2, 3}
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.learn_and_score(docs, labels).collect()} == {1, 2, 3}
    found = {r.doc_id: r.lang_pred for r in langid.learn_and_identify(docs).collect()}
    assert found[1] == "en" and found[3] == "und"
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    index = {r.page_id: r for r in warc.archive_index(*warc.write_archive(pages)).collect()}
    assert index[1].payload_digest == hashlib.sha1(rows[0][1].encode()).hexdigest() and index[3].payload_bytes == 0


def test_workers_take_texts_in_slices_of_bounded_bytes():
    import pyarrow as pa

    from ananas.llm.shared import slices

    texts = ["a" * 40, None, "\u00e9" * 30, "", "b" * 500, "c" * 10] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "t"])
    parts = list(slices([batch, batch.slice(0, 0)], 1, 200))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == texts
    for p in parts:
        sizes = [len((v or "").encode()) for v in p.column(1).to_pylist()]
        assert sum(sizes) - max(sizes, default=0) <= 200
    assert len(parts) > 20
