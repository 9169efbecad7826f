"""Hard-negative mining over Parquet blocks in Hilbert order, with a zone map for each block.

Rows are sorted by label and by their place on a Hilbert curve and written in blocks of
``BLOCK_ROWS``; a block row has the least and greatest value of each dimension beside its packed
vectors. Interval arithmetic on that zone map bounds every inner product with an anchor, so a
block is multiplied only for the anchors that have a window its interval reaches, and a folder of
blocks is read only where one of its blocks is. Anchors are the query set: they go through in
chunks of bounded size, each against all blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ananas.llm.shared import forget, shared_root, written

BLOCK_ROWS = 256
#: Bytes of vectors in a folder of blocks, while there are at most ``MOST_FOLDERS``; beyond, folders grow.
FOLDER_BYTES, MOST_FOLDERS = 4 << 20, 4096
#: Bytes of anchor vectors broadcast at a time.
CHUNK_BYTES = 2 << 20
#: Rows, about, whose scores give the first lower bounds; bounds only save work, they change no result.
SAMPLE_ROWS = 2048
#: The curve runs over the dimensions of greatest variance, with this many bits each.
CURVE_DIMS, CURVE_BITS = 32, 2
#: Largest size of a component of a vector, so that scores of up to 2,048 dimensions fit 64 bits.
LARGEST = 1 << 26
#: Candidates a task holds before it keeps the best of each target.
HELD = 1 << 18


def quantised(df: DataFrame, ident: str, label: Column, vector: str) -> DataFrame:
    """(id, label, v): each component x as floor(256 * x), of at most ``LARGEST`` in size.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    """
    x = F.col("v")
    rows = df.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, finite))
    clipped = lambda c: F.greatest(F.lit(-LARGEST).cast("double"), F.least(F.lit(LARGEST).cast("double"), c.cast("double") * 256))
    return rows.withColumn("v", F.transform(x, lambda c: F.floor(clipped(c)).cast("int")))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of ``bits``-bit coordinates (at most 64 bits a row).

    After Skilling's transform: undo the rotations from the top bit down, Gray-code, interleave.
    """
    x = cells.astype(np.uint64).T.copy()
    one, top = np.uint64(1), 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(len(x)):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in reversed(range(bits)):
        for row in x:
            key = (key << one) | (((row ^ turn) >> np.uint64(b)) & one)
    return key


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of each length of the vectors of a batch."""
    dims = np.asarray(pa.compute.list_value_length(column))
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


@dataclass
class Index:
    """Folders of blocks at ``path``; ``exact`` where doubles hold every score."""

    blocks: DataFrame
    sample: list
    exact: bool


def build_index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, folder_bytes: int = FOLDER_BYTES) -> Index | None:
    """Write (id, label, v) in blocks; None where there is no row.

    Blocks hold one label and one length. Equal vectors lie side by side by id, so a group of
    copies of any size fills many blocks and folders. The curve's cells are quarters of each
    dimension under a normal law (by mean and deviation over all rows).
    """
    stats = rows.select(F.posexplode("v").alias("pos", "x"), F.size("v").alias("dim")).groupBy("dim", "pos")
    stats = stats.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max(F.abs("x")).alias("top")).collect()  # a row per dimension
    cuts, n_rows, n_bytes, exact = {}, 0, 0, True
    for dim in {r["dim"] for r in stats}:
        own = sorted((r for r in stats if r["dim"] == dim), key=lambda r: r["pos"])
        mean, std = np.array([r["mean"] for r in own]), np.array([r["std"] for r in own])
        dims = np.sort(np.argsort(-std, kind="stable")[:CURVE_DIMS])
        cuts[dim] = dims, mean[dims], np.where(std[dims] > 0, std[dims], 1.0)
        n_rows, n_bytes = n_rows + own[0]["n"], n_bytes + 4 * dim * own[0]["n"]
        exact &= dim * max(r["top"] for r in own) ** 2 < 1 << 53
    if not n_rows:
        n_rows = rows.count()
        if not n_rows:
            return None

    def keyed(batches):
        for batch in batches:
            vectors = batch.column(2)
            key = np.zeros(len(vectors), dtype=np.uint64)
            for dim, at in _by_dim(vectors):
                if dim in cuts:
                    dims, mean, std = cuts[dim]
                    z = (_matrix(vectors.take(pa.array(at)), dim)[:, dims] - mean) / std
                    key[at] = hilbert_keys(np.digitize(z, [-0.6745, 0.0, 0.6745]), CURVE_BITS)
            signed = (key ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, pa.array(signed)], names=["id", "label", "v", "key"])

    def cut(batches):
        run, made = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def block(t: pa.Table, dim: int, label: int):
            nonlocal made
            m = _matrix(t["v"].combine_chunks(), dim).astype(np.int32)
            made += 1
            return {
                "run": run, "block": (run << 32) + made, "dim": dim, "label": label, "n": len(m),
                "low": m.min(axis=0).tolist(), "high": m.max(axis=0).tolist(),
                "ids": t["id"].to_numpy().astype(np.int64).tobytes(), "vectors": m.tobytes(),
            }

        def blocks(table: pa.Table, last: bool):
            """Blocks of the stretches of one label and length; what may go on is held back."""
            held.clear()
            label, dim = table["label"].to_numpy(), np.asarray(pa.compute.list_value_length(table["v"]))
            edges = np.r_[0, np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1, len(label)]
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                for s in range(a, b, BLOCK_ROWS):
                    e = min(s + BLOCK_ROWS, b)
                    if e == len(label) and e - s < BLOCK_ROWS and not last:
                        held.append(table.slice(s))
                    else:
                        out.append(block(table.slice(s, e - s), int(dim[a]), int(label[a])))
            return out

        for batch in batches:
            if batch.num_rows:
                table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
                for start in range(0, len(out := blocks(table, False)), 16):
                    yield pa.RecordBatch.from_pylist(out[start : start + 16], schema=_BLOCK)
        if held:
            yield pa.RecordBatch.from_pylist(blocks(held[0], True), schema=_BLOCK)

    folders = int(min(MOST_FOLDERS, max(1, -(-n_bytes // folder_bytes))))
    keys = rows.select("id", "label", "v").mapInArrow(keyed, "id long, label long, v array<int>, key long").withColumn("dim", F.size("v"))
    order = ["dim", "label", "key", "id"]
    dealt = keys.repartitionByRange(folders, *order).sortWithinPartitions(*order)
    blocks = written(dealt.select("id", "label", "v").mapInArrow(cut, _BLOCK_DDL), "blocks", by="run")
    share = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n_rows) * (1 << 30))
    return Index(blocks, rows.filter(share).limit(4 * sample_rows).collect(), exact)


_BLOCK_DDL = "run int, block long, dim int, label long, n int, low array<int>, high array<int>, ids binary, vectors binary"
_BLOCK = pa.schema([
    ("run", pa.int32()), ("block", pa.int64()), ("dim", pa.int32()), ("label", pa.int64()), ("n", pa.int32()),
    ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("ids", pa.binary()), ("vectors", pa.binary()),
])


@dataclass
class Wanted:
    """Of every anchor the best ``k`` rows of some windows.

    ``low``, ``high``: windows of scores, (windows, anchors); NaN for no window. ``least``,
    ``least_id``: a score and id that the k-th best row is known to reach. ``same``: rows of the
    anchor's label, else of the others.
    """

    same: bool
    k: int
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    least_id: np.ndarray


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    dims: np.ndarray
    vectors: dict[int, np.ndarray]  # by length, in the order of the anchors of that length

    @classmethod
    def of(cls, rows) -> Anchors:
        dims = np.array([len(r["v"]) for r in rows], dtype=np.int64)
        by = {int(d): np.array([rows[i]["v"] for i in np.flatnonzero(dims == d)], dtype=np.int64).reshape(-1 if d else int((dims == d).sum()), int(d)) for d in np.unique(dims)}
        return cls(np.array([r["id"] for r in rows], dtype=np.int64), np.array([r["label"] for r in rows], dtype=np.int64), dims, by)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: least and greatest inner product of each anchor with any point of each box.

    Doubles of integers; a margin covers what rounding may take from sums beyond 2^53.
    """
    up, down, low, high = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float), low.astype(float).T, high.astype(float).T
    margin = 1e-12 * ((up - down) @ np.maximum(np.abs(low), np.abs(high)))
    return up @ low + down @ high - margin, up @ high + down @ low + margin


def _reached(a: Anchors, w: Wanted, at: np.ndarray, least: np.ndarray, most: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(anchors ``at``, boxes): does a window of the anchor meet the interval of the box."""
    some = np.zeros(least.shape, dtype=bool)
    with np.errstate(invalid="ignore"):
        for j in range(len(w.low)):
            some |= (most >= np.fmax(w.low[j][at], w.least[j][at])[:, None]) & (least <= w.high[j][at][:, None]) & ~np.isnan(w.low[j][at])[:, None]
    return some & ((a.labels[at][:, None] == labels[None]) == w.same)


class _Best:
    """The best k rows of each target seen so far: (target, score, id), target = window * anchors + anchor."""

    def __init__(self, w: Wanted):
        self.w, self.n, self.held = w, w.low.shape[1], 0
        self.least, self.least_id = w.least.copy(), w.least_id.copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        for j in range(len(self.w.low)):
            floor, tie = self.least[j][at][:, None], self.least_id[j][at][:, None]
            with np.errstate(invalid="ignore"):
                ok = (scores >= self.w.low[j][at][:, None]) & (scores <= self.w.high[j][at][:, None])
                ok &= (scores > floor) | ((scores == floor) & (ids[None] <= tie))
            ok &= own[:, None] != ids[None]
            r, c = np.nonzero(ok)
            if len(r):
                self.parts.append((j * self.n + at[r], scores[r, c].astype(np.int64), ids[c]))
                self.held += len(r)
                if self.held > HELD:
                    self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, dtype=np.int64),) * 3
        t, s, i = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((i, -s, t))
        t, s, i = t[order], s[order], i[order]
        start = np.r_[0, np.flatnonzero(t[1:] != t[:-1]) + 1]
        rank = np.arange(len(t)) - np.repeat(start, np.diff(np.r_[start, len(t)]))
        full = rank == self.w.k - 1
        self.least.reshape(-1)[t[full]], self.least_id.reshape(-1)[t[full]] = s[full], i[full]
        keep = rank < self.w.k
        self.parts, self.held = [(t[keep], s[keep], i[keep])], int(keep.sum())
        return self.parts[0]


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; by doubles where those hold them, else in 64-bit integers."""
    return a.astype(float) @ b.astype(float).T if exact else a.astype(np.int64) @ b.astype(np.int64).T


def _first_bounds(a: Anchors, w: Wanted, sample, exact: bool) -> Wanted:
    """``w`` with the bounds that the rows of a sample give."""
    best = _Best(w)
    by = Anchors.of(sample) if sample else None
    for dim, vectors in a.vectors.items():
        at = np.flatnonzero(a.dims == dim)
        if by is None or dim not in by.vectors:
            continue
        rows = np.flatnonzero(by.dims == dim)
        for s in range(0, len(at), 256):
            scores = _scores(vectors[s : s + 256], by.vectors[dim], exact)
            for label in np.unique(by.labels[rows]):
                own = np.flatnonzero(by.labels[rows] == label)
                who = np.flatnonzero((a.labels[at[s : s + 256]] == label) == w.same)
                if len(who):
                    best.add(at[s + who], scores[np.ix_(who, own)], by.ids[rows[own]], a.ids[at[s + who]])
    best.settle()
    return Wanted(w.same, w.k, w.low, w.high, best.least, best.least_id)


def _search(index: Index, a: Anchors, w: Wanted) -> tuple[DataFrame, Broadcast]:
    """(target, score, id, place): the best k rows of every target, ties by smaller id; and what it has broadcast."""
    spark = index.blocks.sparkSession
    exact, shared = index.exact, spark.sparkContext.broadcast((a, _first_bounds(a, w, index.sample, index.exact)))
    k = w.k

    def reached_runs(batches):
        a, w = shared.value
        runs = set()
        for batch in batches:
            for dim, at in _by_dim(batch.column(3)):
                if dim in a.vectors:
                    some = batch.take(pa.array(at))
                    least, most = bounds(a.vectors[dim], _matrix(some.column(3), dim), _matrix(some.column(4), dim))
                    hit = _reached(a, w, np.flatnonzero(a.dims == dim), least, most, some.column(2).to_numpy()).any(axis=0)
                    runs.update(some.column(0).to_numpy()[hit].tolist())
        yield pa.RecordBatch.from_pydict({"run": pa.array(sorted(runs), pa.int32())})

    def read(batches):
        a, w = shared.value
        best = _Best(w)
        for batch in batches:
            for r in batch.to_pylist():
                dim, label = r["dim"], r["label"]
                if dim not in a.vectors:
                    continue
                now = Wanted(w.same, w.k, w.low, w.high, best.least, best.least_id)
                at = np.flatnonzero(a.dims == dim)
                least, most = bounds(a.vectors[dim], np.array([r["low"]]).reshape(1, dim), np.array([r["high"]]).reshape(1, dim))
                hit = np.flatnonzero(_reached(a, now, at, least, most, np.array([label]))[:, 0])
                if len(hit):
                    block = np.frombuffer(r["vectors"], dtype=np.int32).reshape(r["n"], dim)
                    best.add(at[hit], _scores(a.vectors[dim][hit], block, exact), np.frombuffer(r["ids"], dtype=np.int64), a.ids[at[hit]])
        t, s, i = best.settle()
        yield pa.RecordBatch.from_pydict({"target": t, "score": s, "id": i})

    zones = index.blocks.select("run", "block", "label", "low", "high")
    runs = [r["run"] for r in zones.mapInArrow(reached_runs, "run int").distinct().collect()]  # at most MOST_FOLDERS
    blocks = index.blocks.filter(F.col("run").isin(runs)) if runs else index.blocks.limit(0)
    found = blocks.select("dim", "label", "n", "low", "high", "ids", "vectors").mapInArrow(read, "target long, score long, id long")
    # a task gives at most k rows of a target
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k), shared


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Hard negatives of the rows (id, label, v) that ``anchor`` picks.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the positives of
    an anchor are its best other rows of its label, the negatives of each are the best rows of
    other labels whose score is ``low`` to ``high`` percent of the positive's. Scores are inner
    products; higher first, ties by smaller id. A positive's score below 0 leaves no window; an
    anchor without a positive or a window without a row gives no row. Vectors of different
    lengths do not meet (all without a component score 0). Rows that repeat an id are rows of
    their own, also as anchors, but none is another row to its own id. No rows: no result.
    """
    spark = rows.sparkSession
    index = build_index(rows)
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    names = [x.split()[0] for x in kinds.split(", ")]
    empty = spark.createDataFrame([], kinds)
    if index is None:
        return empty
    path = f"{shared_root(spark)}/ananas-llm/{uuid.uuid4().hex}"
    asked = written(rows.filter(anchor), "anchors")
    size = asked.agg(F.sum(4 * F.size("v") + 32).alias("b")).first()["b"]
    if not size:
        return empty
    chunks = -(-size // chunk_bytes)
    chunked = written(asked.repartition(chunks).withColumn("chunk", F.spark_partition_id()), "chunks", by="chunk")
    for c in range(chunks):
        a = Anchors.of(chunked.filter(F.col("chunk") == c).collect())
        n = len(a.ids)
        if not n:
            continue
        whole = lambda x, m=n: np.full((1, m), x)
        first = Wanted(True, positives, whole(-np.inf), whole(np.inf), whole(-np.inf), np.full((1, n), np.iinfo(np.int64).max))
        score, ident = np.full((positives, n), np.nan), np.zeros((positives, n), dtype=np.int64)
        lowest, highest = np.full((positives, n), np.nan), np.full((positives, n), np.nan)
        best, sent = _search(index, a, first)
        for r in best.collect():  # at most ``positives`` an anchor
            j, t, s = r["place"] - 1, r["target"], r["score"]
            ident[j, t], score[j, t] = r["id"], s
            lowest[j, t], highest[j, t] = -(-low * s // 100), high * s // 100
        sent.unpersist()
        kept = np.where(np.isnan(score), 0, score).astype(np.int64)
        windows = Wanted(False, negatives, lowest, highest, np.full((positives, n), -np.inf), np.full((positives, n), np.iinfo(np.int64).max))
        shared = spark.sparkContext.broadcast((a.ids, ident, kept))

        def named(batches, shared=shared):
            ids, ident, kept = shared.value
            for batch in batches:
                t = batch.column(0).to_numpy()
                j, i = t // len(ids), t % len(ids)
                columns = [ids[i], ident[j, i], batch.column(3).to_numpy().astype(np.int32), batch.column(2), kept[j, i], batch.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=names)

        best, sent = _search(index, a, windows)
        best.select("target", "score", "id", "place").mapInArrow(named, kinds).write.parquet(f"{path}/found/part={c}")
        sent.unpersist()
        shared.unpersist()
    forget(index.blocks, asked, chunked)
    return spark.read.schema(kinds).parquet(*[f"{path}/found/part={c}" for c in range(chunks)])


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, label, embedding): anchors have an id divisible by
    100; where it is divisible by 7, the label first becomes (label + 1) % 10. See ``quantised`` for
    the rows that take no part and ``mine`` for the rest; other columns are not looked at."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(embeddings, "vec_id", label, "embedding"), F.col("id") % 100 == 0)
