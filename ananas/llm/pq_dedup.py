"""Embedding near-duplicates by product quantisation.

Unit vectors are assigned to coarse inverted lists; what is left of each (its residual) is coded
by one codeword for each subspace. A query visits its ``PROBES`` nearest lists, estimates every
cosine there from lookup tables (asymmetric distance), and keeps what the estimate plus the known
error of the code cannot rule out; those are compared exactly, in double precision. Centroids and
codewords are fitted on a bounded sample; every vector is indexed. Equal vectors are one class.
Lists are cut into blocks, so a task holds at most two blocks whatever the size of a list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.llm.shared import components, written

COSINE = 0.93
#: Vectors that centroids and codewords are fitted on, at most (on average).
SAMPLE_ROWS = 16384
#: Inverted lists: one for about this many vectors, and at most MOST_LISTS.
LIST_ROWS, MOST_LISTS = 400, 512
PROBES = 6
SUBSPACES, CODEWORDS = 8, 64
#: Rows of a list's block.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's steps from a seeded choice of rows; empty ones keep their place."""
    c = x[np.random.default_rng(seed).choice(len(x), size=k, replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first."""
    d = (c * c).sum(axis=1) - 2 * x @ c.T
    part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    return np.take_along_axis(part, np.take_along_axis(d, part, axis=1).argsort(axis=1, kind="stable"), axis=1)


@dataclass
class Index:
    centroids: np.ndarray  # (lists, dims)
    codebook: np.ndarray  # (subspaces, codewords, dims of a subspace), zero-padded
    probes: int

    def parts(self, r: np.ndarray) -> np.ndarray:
        m, _, d = self.codebook.shape
        return np.pad(r, ((0, 0), (0, m * d - r.shape[1]))).reshape(len(r), m, d)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): the codeword of each subspace of the residual, and the length of what they miss."""
        parts = self.parts(x - self.centroids[home])
        code = np.stack([nearest(parts[:, m], self.codebook[m], 1)[:, 0] for m in range(parts.shape[1])], axis=1)
        miss = parts - np.stack([self.codebook[m][code[:, m]] for m in range(parts.shape[1])], axis=1)
        return code.astype(np.uint8), np.sqrt((miss * miss).sum(axis=(1, 2)))

    def estimate(self, q: np.ndarray, code: np.ndarray, home: int) -> np.ndarray:
        """Cosines of queries with the coded vectors of one list, from a table for each query."""
        table = np.einsum("qmd,mkd->qmk", self.parts(q), self.codebook)
        out = np.repeat((q @ self.centroids[home])[:, None], len(code), axis=1)
        for m in range(code.shape[1]):
            out += table[:, m][:, code[:, m]]
        return out


def fit(x: np.ndarray, rows: int, probes: int = PROBES) -> Index:
    lists = int(max(1, min(MOST_LISTS, rows // LIST_ROWS, len(x) // 4)))
    c = kmeans(x, lists)
    r = x - c[nearest(x, c, 1)[:, 0]]
    d = -(-x.shape[1] // SUBSPACES)
    parts = np.pad(r, ((0, 0), (0, SUBSPACES * d - x.shape[1]))).reshape(len(r), SUBSPACES, d)
    k = min(CODEWORDS, len(x))
    return Index(c, np.stack([kmeans(parts[:, m], k) for m in range(SUBSPACES)]), min(probes, lists))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): unit vectors as doubles; those that can't be compared have null."""

    def run(batches):
        for batch in batches:
            units = []
            for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                ok = label is not None and v and all(c is not None for c in v)
                x = np.array(v, dtype=np.float64) if ok else np.zeros(1)
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = x / top if top > 0 else x  # lengths neither overflow nor vanish
                units.append((x / np.sqrt((x * x).sum())).tobytes() if top > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])

    t = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {t['vec_id']}, label {t['label']}, unit binary")


def _join(index: Index, cosine: float):
    def matrix(col) -> np.ndarray:
        return np.frombuffer(b"".join(col), dtype=np.float64).reshape(len(col), -1)

    def run(key, queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        """Links of a block of queries with a block of a list: their number, and a spanning forest.

        A pair that either side finds is counted once for each: in the task of the other's list for
        itself, and for the other, too, if that one doesn't visit the query's own list.
        """
        empty = pd.DataFrame({"cls": [], "n": [], "to": []}).astype("int64")
        if queries.empty or items.empty:
            return empty
        home = int(key[1])
        q, x = matrix(queries["unit"]), matrix(items["unit"])
        code = np.frombuffer(b"".join(items["code"]), dtype=np.uint8).reshape(len(x), -1)
        maybe = index.estimate(q, code, home) + items["error"].to_numpy() >= cosine - 1e-9
        a, b = np.nonzero(maybe)
        qc, xc = queries["cls"].to_numpy(), items["cls"].to_numpy()
        exact = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        link = (exact >= cosine) & (qc[a] != xc[b])
        a, b = a[link], b[link]
        if not len(a):
            return empty
        probes = np.stack(items["probes"].to_numpy())
        oneway = ~(probes[b] == queries["home"].to_numpy()[a][:, None]).any(axis=1)
        nodes, at = np.unique(np.r_[qc[a], xc[b]], return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        n = np.bincount(u, items["copies"].to_numpy()[b], len(nodes)) + np.bincount(v[oneway], queries["copies"].to_numpy()[a[oneway]], len(nodes))
        least = np.arange(len(nodes))
        while True:  # the least node that is reachable within the block
            was = least.copy()
            np.minimum.at(least, u, least[v])
            np.minimum.at(least, v, least[u])
            least = least[least]
            if (was == least).all():
                break
        return pd.DataFrame({"cls": nodes, "n": n.astype("int64"), "to": nodes[least]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, label, embedding): n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine is at least ``cosine``; vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, and so do
    vectors of different lengths. Repeated rows are vectors of their own. A row with a null id
    counts as a link, but its id is nobody's component unless no other id is there. Other columns are
    ignored.
    """
    v = unit_vectors(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "unit")
    v = written(v, "vectors")
    usable = v.filter("unit is not null")
    classes = usable.groupBy("label", "unit").agg(F.min("row").alias("cls"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = written(classes, "classes")
    lengths = [r["d"] for r in classes.select(F.octet_length("unit").alias("d")).distinct().collect()]  # lengths of vectors, a few
    found = None
    for d in lengths:
        part = classes.filter(F.octet_length("unit") == d)
        links = _links(part, cosine, probes, sample_rows, block)
        found = links if found is None else found.union(links)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(found, "links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("to").alias("b"))).select(F.col("id").alias("cls"), "component")
    c = classes.join(counts, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = c.groupBy("component").agg(F.min("least").alias("component_id"))
    c = c.join(lowest, "component").select("label", "unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = v.join(c, ["label", "unit"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def _links(classes: DataFrame, cosine: float, probes: int, sample_rows: int, block: int) -> DataFrame:
    rows = classes.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = [r["unit"] for r in classes.filter(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("unit").collect()]  # bounded by sample_rows
    if not sample:
        sample = [r["unit"] for r in classes.select("unit").limit(1).collect()]
    index = fit(np.stack([np.frombuffer(u, dtype=np.float64) for u in sorted(sample)]), rows, probes)
    shared = classes.sparkSession.sparkContext.broadcast(vars(index))  # fixed by MOST_LISTS and CODEWORDS

    def assign(batches):
        for batch in batches:
            if not len(batch):
                continue
            ix = Index(**shared.value)
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(len(batch), -1)
            near = nearest(x, ix.centroids, ix.probes)
            code, error = ix.encode(x, near[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0].astype(np.int32)), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error)], names=["cls", "unit", "label", "copies", "home", "probes", "code", "error"])

    t = classes.schema["label"].dataType.simpleString()
    coded = classes.select("cls", "unit", "label", "copies").mapInArrow(assign, f"cls long, unit binary, label {t}, copies long, home int, probes array<int>, code binary, error double")
    coded = written(coded, "coded")
    # blocks of a list by hash: a list of n rows has about n / block of them
    blocks = coded.groupBy("label", "home").agg((F.floor(F.count("*") / block) + 1).alias("blocks"))
    items = coded.join(blocks, ["label", "home"]).withColumn("item_block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    queries = coded.select("cls", "unit", "label", "copies", "home", F.explode("probes").alias("list"))
    queries = queries.join(blocks.withColumnRenamed("home", "list"), ["label", "list"])
    # queries of a list are cut the same way; each pair of blocks is a task
    visits = queries.groupBy("label", "list").agg((F.floor(F.count("*") / block) + 1).alias("parts"))
    queries = queries.join(visits, ["label", "list"]).withColumn("query_block", F.pmod(F.xxhash64("cls"), F.col("parts")))
    queries = queries.withColumn("item_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "parts")
    items = items.join(visits.withColumnRenamed("list", "home"), ["label", "home"]).withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("blocks", "parts")
    items = items.withColumnRenamed("home", "list")
    items = items.toDF(*items.columns)  # columns of their own, for a join with rows of the same table
    key = ["label", "list", "item_block", "query_block"]
    join = _join(index, cosine)
    return queries.groupBy(*key).cogroup(items.groupBy(*key)).applyInPandas(join, "cls long, n long, to long")
