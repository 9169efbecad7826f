"""N-gram Jaccard join: shingles hashed into groups, group counts as points of packed R-trees.

A text is its set of 4-word shingles. Pairs can only link if they share one of their rarest
shingles (the first ``n - ceil(t n) + 1`` in a global order of rarity), so documents meet in the
bucket of such a shingle, cut into blocks. The shingle counts of hash groups are a point; the overlap
of two sets is at most the sum of the smaller coordinates. An R-tree packed over the points of a
block prunes whole branches by that bound and by size, the points and places prune pairs, and what
is left is compared by its words.

Near copies share many rare shingles and meet in the bucket of each. A pair counts where it meets
first: every row of a bucket names the buckets its document was in just before, and a pair that has one
of them in common has met there.

The first round takes of every document in a block its best partner there and in the next block,
and of every block the pairs of the member with most partners, so groups of near copies are joined by about as many pairs as buckets have members; the last takes all pairs of all blocks of a bucket
that still are in different components, so no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ananas.llm.bytetext import mixed, powers, prefix_sums, runs, utf8
from ananas.llm.shared import components, forget, free_names, small_side, written

SHINGLE = 4
#: Two texts link from this share of common shingles on, in percent.
PERCENT = 85
#: Least number of groups of a fine point; a text of n shingles has the power of two from 1.5 n on.
GROUPS = 128
#: Groups of the small points that travel with the rows of a bucket, 2 bits each; sets up to this size
#: over 1.5 have no finer point.
SMALL = 256
#: Cells in which shingles are counted to order them by rarity.
CELLS = 1 << 16
#: Points of a leaf of an R-tree, and children of a branch.
LEAF, FANOUT = 64, 8
#: Buckets of so many members are compared many at a time: a tree of theirs is a piece of one leaf.
FEW = 16
#: Rounds that take best pairs alone, before the one that takes all; a second one finds little.
ROUNDS = 1
#: Members of a block of a bucket.
BLOCK = 1024
#: Buckets of a document before the one at hand, by which a pair knows that it has met.
EARLIER = 8
#: Words of a text whose shingles are compared at a time.
PIECE = 1 << 17

def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number by text) of the shingles of texts, not yet distinct.

    A-Z are lower-cased; words lie between ASCII blanks; fewer words than ``shingle`` are one.
    """
    lo = int(offsets[0])
    b = data[lo : int(offsets[-1])]
    o = offsets - lo
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    # a word begins where no word byte of the same text stands before, and ends alike
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[o] = True
    before = np.r_[False, word[:-1]] & ~edge[:-1]
    after = np.r_[word[1:], False] & ~edge[1:] if len(b) else word
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    s = prefix_sums(b)
    _, down = powers(len(b) + 1)
    h = mixed((s[end] - s[start]) * down[start])
    n = np.diff(np.searchsorted(start, o))
    first = np.r_[0, np.cumsum(n)[:-1]]
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    length = np.repeat(np.minimum(n, shingle), count)
    out = length.astype(np.uint64)
    for k in range(shingle):
        more = at + k
        out = np.where(k < length, out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(more, len(h) - 1)] if len(h) else out, out)
    return mixed(out), count


def distinct_sets(column: pa.Array, shingle: int = SHINGLE):
    """(index, sorted distinct hashes) of each text of a column."""
    data, offsets = utf8(column)
    for first, end in runs(offsets):
        h, n = shingle_sets(data, offsets[first : end + 1], shingle)
        at = 0
        for i, k in zip(range(first, end), n):
            yield i, np.unique(h[at : at + k])
            at += k


def needed(n, percent: int = PERCENT):
    """Shingles of n that must be looked up to meet every possible partner."""
    return n - (percent * n + 99) // 100 + 1


def least_overlap(n, m, percent: int = PERCENT):
    """Smallest overlap with which sets of n and m shingles link: 100 o >= percent (n + m - o)."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def cell_counts(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many shingles of all documents fall into each cell."""

    def run(batches):
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for first, end in runs(offsets):
                h, _ = shingle_sets(data, offsets[first : end + 1], shingle)
                cells += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=CELLS)
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(cells[full])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most CELLS
    out = np.zeros(CELLS, dtype=np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


def point_of(h: np.ndarray) -> bytes:
    """Counts of shingles by hash group: two bits a group, then what lies beyond three, in all.

    There are more groups than shingles, so sets that differ in a few shingles seldom hide that.
    """
    groups = GROUPS
    while 2 * groups < 3 * len(h):
        groups *= 2
    counts = np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    low = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    packed = low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6
    return packed.tobytes() + np.uint32((counts - np.minimum(counts, 3)).sum()).tobytes()


def unpacked(points: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts up to three, rest) of points with the same number of groups."""
    raw = np.frombuffer(b"".join(points), dtype=np.uint8).reshape(len(points), -1)
    rest = np.ascontiguousarray(raw[:, -4:]).view(np.uint32)[:, 0].astype(np.int64)
    low = (raw[:, :-4, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    return low.reshape(len(points), -1), rest


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts with their groups merged to ``groups``."""
    if counts.shape[1] == groups:
        return counts
    return counts.reshape(len(counts), -1, groups).sum(axis=1, dtype=np.uint32)


def allowed(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the points of each pair leave room for the overlap it needs, at the finest common groups.

    Beyond three in a group, two sets share at most the lesser rest, or the larger once groups are merged.
    """
    kind = np.array([(len(a), len(b)) for a, b in zip(x, y)], dtype=np.int64).reshape(-1, 2)
    keep = np.zeros(len(x), dtype=bool)
    for u, v in np.unique(kind, axis=0):
        own = np.flatnonzero((kind == (u, v)).all(axis=1))
        groups = 4 * (int(min(u, v)) - 4)
        for part in np.array_split(own, max(1, len(own) * int(max(u, v)) >> 21)):
            (a, more_a), (b, more_b) = (unpacked([z[i] for i in part]) for z in (x, y))
            bound = np.minimum(folded(a, groups), folded(b, groups)).sum(axis=1, dtype=np.int64)
            bound += np.minimum(more_a, more_b) if u == v else np.maximum(more_a, more_b)
            keep[part] = bound >= least_overlap(n[part], m[part], percent)
    return keep


def small_point(h: np.ndarray) -> bytes:
    """Counts up to three of ``SMALL`` hash groups, two bits each."""
    low = np.minimum(np.bincount((h & np.uint64(SMALL - 1)).astype(np.int64), minlength=SMALL), 3).astype(np.uint8).reshape(-1, 4)
    return (low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6).tobytes()


_SETS = "row long, doc_id long, th long, n long, digest binary, tokens array<long>, point binary, small binary"


def document_sets(docs: DataFrame, cells: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: size and digest of its set, its rarest shingles and its point, written.

    A copy of a set that its task has already seen carries no shingles: it is in the first one's class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cells)  # fixed by CELLS

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            sizes, digests, tokens, points, smalls = [], [], [], [], []
            for _, h in distinct_sets(batch.column(3), shingle):
                d = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                new = len(h) > 0 and d not in seen
                seen.add(d)
                sizes.append(len(h))
                digests.append(d)
                rare = h[np.lexsort((h, shared.value[(h >> np.uint64(48)).astype(np.int64)]))[: needed(len(h), percent)]] if new else h[:0]
                tokens.append(rare.view(np.int64))
                points.append(point_of(h) if new and 3 * len(h) > 2 * SMALL else None)
                smalls.append(small_point(h) if new else None)
            lengths = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
            cols = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)), pa.array(points, pa.binary()), pa.array(smalls, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _SETS.split(", ")])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    out = written(keyed.mapInArrow(run, _SETS), "sets")
    shared.unpersist()
    return out


def bucket_rows(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(tok, block, more, row, n, pos, earlier): members of buckets that may link there, written.

    A pair need only be found at its first common shingle. What follows that one bounds the overlap, so
    its place in the smaller set is among the first ``n - least_overlap(n, n) + 1``: there the member is
    ``indexed``. In order of size, a member stays if the last indexed one before it is large enough, or if
    it is indexed and the next one small enough: any partner's size lies between.

    ``earlier``: the last buckets, in the order of shingles, in which the document stayed before this one.
    """
    t = sets.select("row", F.col("n").alias("_n"), F.posexplode("tokens").alias("_pos", "tok"))
    # size and place travel as one number, in order of size
    t = t.select("tok", "row", (F.shiftleft("_n", 32) + F.col("_pos")).alias("at"))
    n, pos = F.shiftright("at", 32), F.col("at").bitwiseAND((1 << 32) - 1).cast("int")
    indexed = n - pos >= F.floor((percent * 2 * n + 99 + percent) / (100 + percent))
    w = Window.partitionBy("tok").orderBy("at", "row")
    before = F.last(F.when(indexed, n), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after, block = F.shiftright(F.lead("at").over(w), 32), F.floor((F.row_number().over(w) - 1) / BLOCK).cast("int")
    more = F.lead("at", BLOCK).over(w).isNotNull()  # some of them have a block after theirs
    t = t.select("tok", "row", n.alias("n"), pos.alias("pos"), indexed.alias("indexed"), before.alias("before"), after.alias("after"), block.alias("block"), more.alias("more"))
    fits = lambda small, large: F.coalesce(F.col(small) * 100 >= F.col(large) * percent, F.lit(False))
    t = t.filter(fits("before", "n") | (F.col("indexed") & fits("n", "after")))
    earlier = F.collect_list("tok").over(Window.partitionBy("row").orderBy("pos").rowsBetween(-EARLIER, -1))
    return written(t.select("tok", "block", "more", "row", F.col("n").cast("int").alias("n"), "pos", earlier.alias("earlier")), "buckets")


def _bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose fine points allow the overlap they need; a pair without such points stays."""
    need = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "bounded_rows")
    p = sets.select("row", "n", "point").filter("point is not null").join(small_side(need), "row", "left_semi")
    joined = pairs.join(p.select(F.col("row").alias("a"), F.col("n").alias("an"), F.col("point").alias("ap")), "a", "left")
    joined = joined.join(p.select(F.col("row").alias("b"), F.col("n").alias("bn"), F.col("point").alias("bp")), "b", "left")
    fine = F.col("ap").isNotNull() & F.col("bp").isNotNull()

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            n, m = (np.asarray(batch.column(i)) for i in (2, 4))
            keep = allowed(batch.column(3).to_pylist(), batch.column(5).to_pylist(), n, m, percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    joined = written(joined.select("a", "b", "an", "ap", "bn", "bp"), "bounded")
    return joined.filter(~fine).select("a", "b").union(joined.filter(fine).mapInArrow(run, "a long, b long"))


def overlap(x: bytes, y: bytes, shingle: int = SHINGLE, piece: int = PIECE) -> tuple[int, int, int]:
    """(common, of x, of y): distinct shingles of two texts, compared by their words.

    A-Z in lower case, words between ASCII blanks. Long texts go in pieces of their shingles, by hash,
    so the sets held at a time stay small.
    """
    words = [t.lower().split() for t in (x, y)]
    n = max(map(len, words))
    if n <= piece:
        a, b = (set(zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else {tuple(w)} if w else set() for w in words)
        return len(a & b), len(a), len(b)
    pieces = -(-n // piece)
    place = [shingle_sets(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]), shingle)[0] % np.uint64(pieces) for t in (x, y)]
    out = np.zeros(3, dtype=np.int64)
    for p in range(pieces):
        a, b = ({tuple(w[k : k + shingle]) for k in np.flatnonzero(at == p).tolist()} for w, at in zip(words, place))
        out += len(a & b), len(a), len(b)
    return tuple(out.tolist())


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, that link by their words; written."""
    rows = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    keys = written(sets.select("row", "doc_id", "th").join(rows, "row"), "verified_rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    # equal rows share a key; either text will do
    side = small_side(keys)
    texts = texts.join(side, texts["id"].eqNullSafe(side["doc_id"]) & (texts["h"] == side["th"])).select("row", "text")
    texts = written(texts, "verified_texts")
    once = texts.dropDuplicates(["row"])
    two = pairs.join(once.select(F.col("row").alias("a"), F.col("text").alias("at")), "a").join(once.select(F.col("row").alias("b"), F.col("text").alias("bt")), "b")

    def run(batches):
        for batch in batches:
            kept = []
            for k in range(len(batch)):
                o, n, m = overlap(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), shingle)
                kept.append(100 * o >= percent * (n + m - o))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    utf8_ = [F.col(c).cast("binary").alias(c) for c in ("at", "bt")]
    links = written(two.select("a", "b", *utf8_).mapInArrow(run, "a long, b long"), "links")
    forget(keys, texts)
    return links


def unpacked_small(points: list[bytes]) -> np.ndarray:
    """Rows of counts up to three of ``small_point``."""
    raw = np.frombuffer(b"".join(points), dtype=np.uint8).reshape(len(points), -1)
    return ((raw[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).reshape(len(points), -1)


def packed(points: np.ndarray, sizes: np.ndarray) -> list[list[tuple]]:
    """Levels of an R-tree, leaves first: (low and high size, largest coordinates, largest rest, children or rows).

    Points are packed in order of size, then along their coordinates of greatest spread.
    """
    spread = np.argsort(-points.var(axis=0), kind="stable")[:2]
    order = np.lexsort((points[:, spread[1]], points[:, spread[0]], sizes))
    rest = sizes - points.sum(axis=1, dtype=np.int64)
    level = []
    for i in range(0, len(order), LEAF):
        own = order[i : i + LEAF]
        level.append((sizes[own].min(), sizes[own].max(), points[own].max(axis=0), rest[own].max(), own))
    levels = [level]
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FANOUT):
            own = level[i : i + FANOUT]
            up.append((min(x[0] for x in own), max(x[1] for x in own), np.max([x[2] for x in own], axis=0), max(x[3] for x in own), own))
        levels.append(up)
        level = up
    return levels


def tree_pairs(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int = PERCENT):
    """(i, j, bound) of rows with different labels whose sizes and points allow a link, by a join of the tree with itself.

    ``points`` are counts up to three; what a set has beyond them is its rest. Two leaves are bounded at
    once: the sum of the smaller counts is an inner product of counts written as ones.
    """
    ones = np.concatenate([points >= k for k in (1, 2, 3)], axis=1).astype(np.float32)
    rest = sizes - points.sum(axis=1, dtype=np.int64)
    stack = [(x, y, len(lv) - 1) for lv in [packed(points, sizes)] for x in lv[-1] for y in lv[-1]]
    while stack:
        x, y, depth = stack.pop()
        if x[1] * 100 < y[0] * percent or y[1] * 100 < x[0] * percent or np.minimum(x[2], y[2]).sum(dtype=np.int64) + min(x[3], y[3]) < least_overlap(x[0], y[0], percent):
            continue
        if depth:
            stack += [(x[4][i], y[4][j], depth - 1) for i in range(len(x[4])) for j in range(i if x is y else 0, len(y[4]))]
            continue
        a, b = x[4], y[4]
        bound = (ones[a] @ ones[b].T).astype(np.int64) + np.minimum(rest[a][:, None], rest[b][None])
        n, m = sizes[a][:, None], sizes[b][None]
        keep = (bound >= least_overlap(n, m, percent)) & (labels[a][:, None] != labels[b][None]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
        if x is y:
            keep = np.triu(keep, 1)
        i, j = np.nonzero(keep)
        if len(i):
            yield a[i], b[j], bound[i, j]


def padded(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, whether there is one): lists of at most ``width`` numbers as rows of that many."""
    there = np.arange(width) < np.asarray(pc.list_value_length(column))[:, None]
    numbers = np.zeros(there.shape, dtype=np.int64)
    numbers[there] = np.asarray(column.flatten())
    return numbers, there


def _block_pairs(key, across, row, n, pos, label, side, small, percent: int, best: bool, earlier=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of whole blocks, one after the other, that sizes, labels, places and points allow.

    ``earlier``: the buckets of each row before this one, ``padded``; rows that have one in common met there. A
    pair that links does so in its first common bucket, and there it has none, so it is never left out.

    ``side``: the block a row is of; ``across``: only rows of different blocks meet.
    ``best``: for every row of a block only the pair with most room, and that with the block's hub.
    """
    start = np.flatnonzero(np.r_[True, np.diff(key) != 0][: len(key)])
    size = np.diff(np.r_[start, len(key)])
    points = unpacked_small(small)
    found = []

    def keep(a, b, bound):
        need = least_overlap(n[a], n[b], percent)
        ok = (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need) & ((side[a] != side[b]) == across[a]) & (bound >= need)
        if earlier is not None and ok.any():
            i = np.flatnonzero(ok)
            ok[i] = ~met(a[i], b[i])
        if ok.any():
            found.append((a[ok], b[ok], (bound - need)[ok]))

    def met(a, b):
        tok, there = earlier
        same = (tok[a][:, :, None] == tok[b][:, None]) & there[a][:, :, None] & there[b][:, None]
        return same.any(axis=(1, 2))

    group = np.repeat(np.arange(len(start)), size)
    for k in range(2, FEW + 1):
        x, y = np.triu_indices(k, 1)
        own = start[size == k][:, None]
        for part in np.array_split(own, max(1, own.size * len(x) >> 15)):
            a, b = (part + x).ravel(), (part + y).ravel()
            near = (label[a] != label[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
            a, b = a[near], b[near]
            low = np.minimum(points[a], points[b]).sum(axis=1, dtype=np.int64)
            rest = [n[v] - points[v].sum(axis=1, dtype=np.int64) for v in (a, b)]
            keep(a, b, low + np.minimum(*rest))
    for i, k in zip(start[size > FEW], size[size > FEW]):
        own = slice(i, i + k)
        if (label[own] != label[i]).any():
            for a, b, bound in tree_pairs(points[own], n[own], label[own], percent):
                keep(a + i, b + i, bound)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b, room = (np.concatenate(x) for x in zip(*found))
    if best:
        who, where, much = np.r_[a, b], np.tile(np.arange(len(a)), 2), np.r_[room, room]
        order = np.lexsort((where, -much, who))
        first = np.r_[True, np.diff(who[order]) != 0]
        # a block's hub has most partners; its pairs tie the others' best pairs together
        degree = np.bincount(who, minlength=len(key))
        hub = np.full(len(start), -1)
        rank = np.lexsort((np.arange(len(key)), degree))
        hub[group[rank]] = rank  # the last of a block has the largest degree
        take = np.unique(np.r_[where[order][first], np.flatnonzero((hub[group[a]] == a) | (hub[group[b]] == b))])
        a, b = a[take], b[take]
    a, b = np.minimum(row[a], row[b]), np.maximum(row[a], row[b])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)]
    return a[first], b[first]


def _candidates(buckets: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of members of a bucket with different labels (a row without one is its own), that may link.

    Without labels a block meets itself and the next, later all blocks of a bucket meet. ``best``: for every row
    of a block, or of two, its best pair and that with a hub; else all.
    """
    m, known, width = buckets, sets.select("row", "small"), EARLIER
    if labels is None:
        m = m.withColumn("label", F.col("row"))
    else:
        m = m.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
        open_ = m.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("block").alias("last")).filter("lo <> hi").select("tok", "last")
        m = m.join(open_, "tok")
    if labels is None:
        own, b = lambda x, y: F.struct(x.alias("x"), y.alias("y")), F.col("block")
        places = F.array(own(b, b), F.when(b > 0, own(b - 1, b)), F.when(F.col("more"), own(b, b + 1)))
        m = m.select("*", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("at")).select("*", "at.x", "at.y")
    else:
        other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
        m = m.select("*", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    m = m.join(known, "row").select("tok", "x", "y", "row", "n", "pos", "label", "block", "small", "earlier")
    # members of a block, or of two, arrive together, smallest first
    m = m.repartition("tok", "x", "y").sortWithinPartitions("tok", "x", "y", "n", "row")

    def run(batches):
        held = None  # the last block so far, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            now = [np.asarray(batch.column(i)) for i in range(8)] + [np.array(batch.column(8).to_pylist(), dtype=object), *padded(batch.column(9), width)]
            now = now if held is None else [np.concatenate(c) for c in zip(held, now)]
            new = np.r_[True, (np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)]
            last = np.flatnonzero(new)[-1]
            yield from pairs(now, np.cumsum(new), slice(0, last))
            held = [c[last:] for c in now]
        if held is not None:
            yield from pairs(held, np.zeros(len(held[0]), dtype=np.int64), slice(None))

    def pairs(now, key, own):
        if len(key[own]):
            x, y, row, n, pos, label, side, small, *earlier = (c[own] for c in now[1:])
            a, b = _block_pairs(key[own], x != y, row, n.astype(np.int64), pos.astype(np.int64), label, side, small.tolist(), percent, best, earlier)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return m.mapInArrow(run, "a long, b long").distinct()


def _components(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, known), written: row, doc_id, th, n and digest of the set of each document; and of each
    digest its component (a row of it)."""
    cells = cell_counts(docs, shingle)
    sets = document_sets(docs, cells, shingle, percent)
    # of equal sets, the first row of each task has shingles; the first of all stands for the class
    full = sets.filter("n > 0")
    classes = written(full.groupBy("digest").agg(F.min("row").alias("rep")), "reps")
    # the rows to leave out are few: one a task at most for a text, where it has copies in several
    extra = sets.filter("small is not null").select("digest", "row").join(classes, "digest").filter("row <> rep").select("row")
    extra = written(extra, "extra")
    reps = sets.filter("small is not null").join(extra, "row", "left_anti")
    reps = reps.select("row", "doc_id", "th", "n", "tokens", "point", "small")

    buckets = bucket_rows(reps, percent)
    used, labels, links, tried = [sets, extra, classes, buckets], None, None, None
    for round_ in range(ROUNDS + 1):
        pairs = _candidates(buckets, labels, reps, percent, best=round_ < ROUNDS)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near")
        left = written(_bound(pairs, reps, percent), "pairs")
        more = _verify(left, reps, docs, shingle, percent)
        used += [pairs, left, more]
        tried, links = left if tried is None else tried.union(left), more if links is None else links.union(more)
        comp = components(links)
        if round_ < ROUNDS:
            labels = written(comp.select(F.col("id").alias("row"), F.col("component").alias("label")), "labels")
            used.append(labels)
    comp = comp.select(F.col("id").alias("rep"), "component")
    known = written(classes.join(comp, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "components")
    rows = written(sets.select("row", "doc_id", "th", "n", "digest"), "rows")
    forget(*used)
    return rows, known


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_shingles and component_id.

    ``component_id`` is the smallest doc_id that links reach, the row's own included. Null and empty
    texts have no shingles and link with nothing. Equal sets are one class, however many rows have
    them. A null id is nobody's component unless the whole component has none. Repeated rows and ids
    are rows of their own. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType
    sets, known = _components(docs, shingle, percent)
    rows = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    low = rows.join(known, "digest").groupBy("component").agg(F.min("doc_id").alias("least"))
    ids = known.join(low, "component").select("digest", "least")
    out = rows.join(ids, "digest", "left")
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").cast(id_type).alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component.

    First is the smallest id, a null one last, then the smallest hash of the text; of rows equal in
    both, one stays. Texts without words have no component and all stay, but for repeated rows.
    """
    sets, known = _components(docs.select("doc_id", "text"), shingle, percent)
    rows = sets.select("row", "doc_id", "th", "n", "digest")
    with_ = rows.filter("n > 0").join(known, "digest")
    best = with_.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")).alias("k"))
    kept = best.select("k.doc_id", "k.th").union(rows.filter("n = 0").select("doc_id", "th")).distinct()
    ident, th = free_names(docs, "id", "th")
    kept = small_side(written(kept.select(F.col("doc_id").alias(ident), F.col("th").alias(th)), "kept"))
    same = lambda d: d["doc_id"].cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64(d["text"]) == F.col(th))
    d = docs.join(kept, same(docs), "left_semi")
    # rows with the id and the text of a kept one: all but one go
    again = sets.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1")
    again = written(again.select(F.col("doc_id").alias(ident), F.col("th").alias(th)), "again")
    if again.isEmpty():
        return d
    once = d.join(again, same(d), "left_semi").dropDuplicates(["doc_id", "text"])
    return d.join(again, same(d), "left_anti").unionByName(once)
