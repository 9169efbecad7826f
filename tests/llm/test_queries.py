"""Registered training-data queries: against their SQL where it exists, else against brute force."""

import argparse
import ast
import collections
import hashlib
import inspect
import random
import re
import typing
import uuid
import zlib

import duckdb
import numpy as np
import pytest

from ananas.llm import queries as Q
from ananas.llm import secrets
from tests.conftest import SF_SMALL

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF_SMALL)
    cur = duck.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(cols, cur.fetchall())


def test_secrets_cover_every_document(spark, duck):
    rows = Q.queries()["op3_secrets"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == [r[0] for r in duck.execute("select doc_id from documents order by 1").fetchall()]
    assert sum(r.n_assign + r.n_hex for r in rows) > 0


def _base(text):
    """The contract's spans by its own patterns, one kind after the other."""
    found = []
    patterns = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]+)", 1, 16),
    ]
    for k, (kind, pattern, group, least) in enumerate(patterns):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


@pytest.mark.parametrize("sf_dir", [SF_SMALL, "/root/testdata/sf0.01"])
def test_secrets_base_columns_by_the_contract(spark, sf_dir):
    texts = duckdb.connect().execute(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in Q.queries()["op3_secrets"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        base = _base(text)
        joined = [f"{k}:{s}:{e}" for k, s, e in base]
        n = collections.Counter(k for k, _, _ in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"])
        assert got[i].base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [x for x in spans if not x.startswith("markov")] == joined and sum(x.startswith("markov") for x in spans) == got[i].n_markov


def test_secret_models_on_held_out_strings(spark):
    """Identifiers, numbers and ids that the models haven't seen are left alone, random strings are found."""
    model = secrets.train(secrets.labelled_strings(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    rng = random.Random(4)
    words = sorted({w for f in (argparse, ast, inspect, typing, collections) for n in dir(f) for w in re.findall("[A-Za-z]{3,}", n.lower())})
    plain = []
    for _ in range(3000):
        w = [rng.choice(words) for _ in range(4)]
        plain += ["_".join(w), "".join(x.title() for x in w), "_".join(w).upper(), "-".join(w)]
    plain = [p for p in plain if len(p) >= secrets.LEAST_LENGTH]
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    keys = ["".join(rng.choice(a) for _ in range(32)) for a in alphabets[1:] for _ in range(1000)]
    found = lambda t: bool(secrets.markov_spans(t, model, []))
    false, recall = np.mean([found(t) for t in plain]), np.mean([found(t) for t in keys])
    print(f"false positives {false:.4f}, recall {recall:.4f}")
    assert false <= 0.01 and recall >= 0.95
    assert np.mean([found(str(uuid.UUID(int=rng.getrandbits(128)))) for _ in range(500)]) <= 0.05
    for t in ("12345678901234567890", "=" * 20, "ACCOUNT_CURRENCY", "getElementsByClassName", "/usr/local/lib/python"):
        assert not found(t), t


def test_toxicity_held_out(spark, duck):
    rows = {r.doc_id: r for r in Q.queries()["op5_toxicity"](spark, SF_SMALL).collect()}
    assert len(rows) == duck.execute("select count(*) from documents").fetchone()[0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    marked = duck.execute("select doc_id, toxic from labels").fetchall()
    clean = [i for i, y in marked if y == 0]
    assert np.mean([rows[i].predicted for i in clean]) < 0.05


def test_toxic_documents_are_caught(spark):
    """On sf0.1, of the labelled documents that were held out: most marked toxic are found (some marks
    are on texts like any other), hardly any of the others."""
    rows = {r.doc_id: r for r in Q.queries()["op5_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    marked = duckdb.connect().execute("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall()
    held = [(rows[i].predicted, y) for i, y in marked if rows[i].held_out and y is not None]
    toxic = [p for p, y in held if y == 1]
    assert len(toxic) >= 20 and np.mean(toxic) >= 0.75 and np.mean([p for p, y in held if y == 0]) < 0.05


def test_language_held_out(spark, duck):
    rows = {r.doc_id: r for r in Q.queries()["op8_language"](spark, SF_SMALL).collect()}
    truth = dict(duck.execute("select doc_id, lang from documents").fetchall())
    held = [i for i, r in rows.items() if r.held_out]
    assert held and all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.9


def test_embedding_links_against_brute_force(spark, duck):
    t = duck.execute("select vec_id, label, embedding from embeddings order by 1").fetchall()
    x = np.array([r[2] for r in t], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[1] for r in t])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    got = {r.vec_id: r.n_links for r in Q.queries()["op7_embedding_dedup"](spark, SF_SMALL).collect()}
    assert len(got) == len(t)
    assert sum(got.values()) >= 0.9 * link.sum()
    assert all(got[r[0]] <= n for r, n in zip(t, link.sum(axis=1)))


def test_pipeline_runs_whole(spark, duck):
    df = Q.queries()["pipeline"](spark, SF_SMALL)
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert set(df.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copies"}
    assert ids and len(ids) == len(set(ids))
