"""Deduplication by windows at anchors: stretches of 50 bytes that an earlier document has are removed.

No suffix array is built and no multikey quicksort is done. Compared are windows around anchors: of each window of 50 bytes the leading
``GRAM`` bytes with the least hash among its places. Equal windows have equal anchors, so no
match is lost. First the anchors' hashes alone are dealt out, and those that a single document
has are dropped. The others, with the bytes around them, are range-partitioned by their leading
bytes with sampled splitters. In a bucket, for each place of an anchor in its window, windows are
grouped by a 64-bit hash, neighbours are compared by their bytes (two keys with one hash: all are
sorted by their bytes), and the smallest document of each group is found: equality is all that
removal needs, and one key sorts cheaper than seven. Nothing is compared across buckets: equal
leading bytes never straddle a boundary, as splitters compare whole leading keys. Copies within a run of
documents are compared there, and only the first goes on, so a passage in a third of all
documents is a row for each run and not for each document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.llm.bytetext import mixed, powers, prefix_sums, runs, utf8
from ananas.llm.shared import small_side, written

MATCH = 50
GRAM = 24
#: Documents that splitters are sampled from, at most (on average).
SAMPLE_DOCS = 2000
#: A null id stands after all others.
LAST = (1 << 63) - 1
#: Anchors that a task holds before it deals them out.
HELD = 65536
#: Ranges of surroundings for each shuffle partition: a task sorts one at a time.
RANGES = 4
#: Of an anchor: owner, hash of the text, place, bytes before and from it on.
KINDS = (np.int64, np.int64, np.uint32, np.uint8, np.uint8)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    if len(data) < gram:
        return np.zeros(0, dtype=np.uint64)
    s = prefix_sums(data)
    _, down = powers(len(data) + 1)
    return mixed((s[gram:] - s[:-gram]) * down[: len(data) - gram + 1])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step] if step else out, out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash) of the anchors of texts."""
    lo = int(offsets[0])
    b, o = data[lo : int(offsets[-1])], offsets - lo
    h = gram_hashes(b, gram)
    width = match - gram + 1
    if len(h) < width:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    rank = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
    least = _slide(rank, width, np.minimum)  # of the window from each place on
    # windows that run over the end of a text choose nothing
    inside = np.zeros(len(least) + 1, dtype=np.int64)
    size = np.diff(o)
    full = size >= match
    np.add.at(inside, o[:-1][full], 1)
    np.add.at(inside, (o[1:] - match + 1)[full], -1)
    chosen = np.where(np.cumsum(inside[:-1]) > 0, least, 0)
    # a place is an anchor if it is the least of a window around it: 0 stands for none
    padded = np.r_[np.zeros(width - 1, dtype=np.uint32), chosen.astype(np.uint32), np.zeros(len(rank) - len(least), dtype=np.uint32)]
    top = _slide(padded, width, np.maximum)
    place = np.flatnonzero(top[: len(rank)] == rank)
    text = np.searchsorted(o, place, side="right") - 1
    return text, place - o[text], h[place]


def _pieces(column: pa.Array, match: int):
    """(first text, data, offsets, start of the first text's piece); long texts come in overlapping pieces."""
    data, offsets = utf8(column)
    for first, end in runs(offsets):
        size = int(offsets[end] - offsets[first])
        if end - first > 1 or size <= 4 << 20:
            yield first, data, offsets[first : end + 1], 0
            continue
        for at in range(0, size, 4 << 20):
            lo = int(offsets[first]) + at
            yield first, data, np.array([lo, min(lo + (4 << 20) + match - 1, int(offsets[end]))]), at


def _anchor_rows(column: pa.Array, match: int, gram: int):
    """(text, place, hash) of all anchors of a column, run by run."""
    for first, data, offsets, at in _pieces(column, match):
        text, place, h = anchors(data, offsets, match, gram)
        yield text + first, place + at, h


def shared_anchors(docs: DataFrame, parts: int, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """(slice, bytes): for each slice of the documents, packed anchors whose hash another id has, too.

    A row is what one part of the hashes has for one slice: number of ids, then ids, counts and places.
    """

    def deal(batches):
        for batch in batches:
            ids, slices = (np.asarray(batch.column(i)) for i in range(2))
            held, n = [], 0
            for rows in _anchor_rows(batch.column(2), match, gram):
                held.append(rows)
                n += len(rows[0])
                if n >= HELD:
                    yield dealt_rows(ids, slices, *map(np.concatenate, zip(*held)))
                    held, n = [], 0
            if n:
                yield dealt_rows(ids, slices, *map(np.concatenate, zip(*held)))

    def dealt_rows(ids, slices, text, place, h):
        part = (h % np.uint64(parts)).astype(np.int64)
        key = (mixed(h) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((text, part))
        part, key, text, place = part[order], key[order], text[order], place[order].astype(np.uint32)
        cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        cols = [[], [], []]
        for i, j in zip(cut[:-1], cut[1:]):
            own, n = np.unique(text[i:j], return_counts=True)
            rest = zlib.compress(place[i:j].tobytes() + ids[own].tobytes() + slices[own].astype(np.int32).tobytes() + n.astype(np.uint32).tobytes(), 6)
            for c, v in zip(cols, (int(part[i]), key[i:j].tobytes(), rest)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "keys", "rest"])

    def meet(batches):
        got = [[], [], [], []]
        for batch in batches:
            for k, rest in zip(*(batch.column(c).to_pylist() for c in (1, 2))):
                key, rest = np.frombuffer(k, dtype=np.uint32), zlib.decompress(rest)
                texts = (len(rest) - 4 * len(key)) // 16
                place, rest = np.frombuffer(rest, dtype=np.uint32, count=len(key)), rest[4 * len(key) :]
                own = np.frombuffer(rest, dtype=np.int64, count=texts)
                cut = np.frombuffer(rest, dtype=np.int32, count=texts, offset=8 * texts)
                n = np.frombuffer(rest, dtype=np.uint32, offset=12 * texts)
                for g, v in zip(got, (key, place, np.repeat(own, n), np.repeat(cut, n))):
                    g.append(v)
        if not got[0]:
            return
        key, place, own, cut = map(np.concatenate, got)
        got.clear()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        lone = np.minimum.reduceat(own[order], starts) == np.maximum.reduceat(own[order], starts)
        keep = order[~np.repeat(lone, np.diff(np.r_[starts, len(key)]))]
        own, place, cut = own[keep], place[keep], cut[keep]
        order = np.lexsort((place, own, cut))
        own, place, cut = own[order], place[order], cut[order]
        ends = np.r_[np.flatnonzero(np.r_[True, np.diff(cut) != 0][: len(cut)]), len(cut)]
        packs = []
        for i, j in zip(ends[:-1], ends[1:]):
            first = np.flatnonzero(np.r_[True, np.diff(own[i:j]) != 0])
            n = np.diff(np.r_[first, j - i]).astype(np.uint32)
            packs.append(np.int64(len(first)).tobytes() + own[i:j][first].tobytes() + n.tobytes() + place[i:j].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cut[ends[:-1]] if len(cut) else np.zeros(0, dtype=np.int32), pa.int32()), pa.array(packs, pa.binary())], names=["slice", "bytes"])

    dealt = docs.select("id", "slice", "text").mapInArrow(deal, "part int, keys binary, rest binary")
    return dealt.repartition(parts, "part").mapInArrow(meet, "slice int, bytes binary")


def _places(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(id, place) of packed anchors, in order."""
    own, place = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for b in packs:
        k = int(np.frombuffer(b, dtype=np.int64, count=1)[0])
        ids = np.frombuffer(b, dtype=np.int64, count=k, offset=8)
        n = np.frombuffer(b, dtype=np.uint32, count=k, offset=8 + 8 * k)
        own.append(np.repeat(ids, n))
        place.append(np.frombuffer(b, dtype=np.uint32, offset=8 + 12 * k).astype(np.int64))
    own, place = np.concatenate(own), np.concatenate(place)
    order = np.lexsort((place, own))
    return own[order], place[order]


def splitters(docs: DataFrame, parts: int, match: int = MATCH, gram: int = GRAM, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Leading keys (8 bytes as a number) that cut the anchors of sampled documents into equal parts."""
    share = min(1.0, sample_docs / max(docs.count(), 1))

    def lead(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            got = [np.zeros(0, dtype=np.uint64)]
            for text, place, h in _anchor_rows(batch.column(0), match, gram):
                pick = (h & np.uint64(15)) == 0  # by its bytes: a passage is taken or left everywhere
                got.append(_keys(data, offsets[text[pick]] + place[pick], 8)[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], names=["lead"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    rows = some.mapInArrow(lead, "lead long").groupBy("lead").agg(F.count("*").alias("n")).collect()  # bounded by sample_docs
    found = np.sort(np.array([r["lead"] for r in rows], dtype=np.int64).view(np.uint64))
    return np.unique(found[(np.arange(1, parts) * len(found)) // parts]) if len(found) else found


def _keys(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each place on, as columns of 8-byte numbers that sort as the bytes do."""
    cols = -(-width // 8)
    index = at[:, None] + np.arange(cols * 8)
    b = data[np.minimum(index, len(data) - 1)]
    b[:, width:] = 0
    return np.ascontiguousarray(b).view(">u8").astype(np.uint64)


def _least_owner(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each row, the least ``own`` among rows with equal ``keys``.

    Rows are sorted by a hash of their keys, then neighbours by the keys themselves.
    """
    h = np.zeros(len(keys), dtype=np.uint64)
    for c in range(keys.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + keys[:, c])
    order = np.argsort(h, kind="stable")
    near = h[order]
    alike = np.r_[False, near[1:] == near[:-1]]
    bad = alike.copy()
    bad[alike] = (keys[order[np.flatnonzero(alike)]] != keys[order[np.flatnonzero(alike) - 1]]).any(axis=1)
    if bad.any():  # two keys with one hash: sort by all of them
        order = np.lexsort(keys.T[::-1])
        sorted_ = keys[order]
        alike = np.r_[False, (sorted_[1:] == sorted_[:-1]).all(axis=1)]
    starts = np.flatnonzero(~alike)
    out = np.empty(len(own), dtype=own.dtype)
    out[order] = np.repeat(np.minimum.reduceat(own[order], starts), np.diff(np.r_[starts, len(own)]))
    return out


def covered(ctx: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before the anchor, bytes from it on) that windows of smaller owners cover; 0, 0 if none.

    ``ctx`` holds for each row the ``match - gram`` bytes before its anchor and ``match`` bytes from it on,
    of which ``left`` and ``right`` are its text's own.
    """
    reach = match - gram
    low = np.full(len(own), reach + 1)
    high = np.full(len(own), -1)
    for o in range(reach + 1):
        rows = np.flatnonzero((left >= o) & (right >= match - o))
        if len(rows) < 2:
            continue
        window = ctx[rows, reach - o : reach - o + match]
        wide = np.zeros((len(rows), -(-match // 8) * 8), dtype=np.uint8)
        wide[:, :match] = window
        dup = _least_owner(wide.view(np.uint64), own[rows]) < own[rows]
        hit = rows[dup]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
    some = high >= 0
    return np.where(some, high, 0), np.where(some, match - low, 0)


def _merge(se: np.ndarray) -> np.ndarray:
    """Sorted (start, end) with overlapping and touching ones merged."""
    if not len(se):
        return se
    se = se[np.argsort(se[:, 0], kind="stable")]
    reach = np.maximum.accumulate(se[:, 1])
    new = np.r_[True, se[1:, 0] > reach[:-1]]
    starts = np.flatnonzero(new)
    return np.column_stack([se[starts, 0], np.maximum.reduceat(se[:, 1], starts)])


def repeated_spans(docs: DataFrame, match: int = MATCH, gram: int = GRAM, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, th, spans): packed maximal stretches, in bytes, that documents with a smaller id have, written.

    ``docs`` has ``id`` and ``th`` (long, not null), which identify a text, and ``text``.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(splitters(docs, RANGES * parts, match, gram, sample_docs))  # a key a range
    docs = docs.withColumn("slice", F.pmod(F.hash("id"), F.lit(parts)).cast("int"))
    places = shared_anchors(docs, parts, match, gram)
    reach = match - gram
    width = reach + match

    def contexts(texts: pa.Table, packs: pa.Table) -> pa.Table:
        """Surroundings of the anchors of one slice of the documents."""
        known, at = _places(packs.column("bytes").to_pylist())
        out = []
        for batch in texts.select(["id", "th", "text"]).to_batches() if len(known) else ():
            ids, ths = (np.asarray(batch.column(i)) for i in range(2))
            data, offsets = utf8(batch.column(2))
            low, high = np.searchsorted(known, ids, side="left"), np.searchsorted(known, ids, side="right")
            held, n = [], 0
            for first, end in runs(offsets):
                # places of another text with the same id may lie outside this one
                own = [at[i:j] for i, j in zip(low[first:end], high[first:end])]
                own = [np.unique(p[p + gram <= k]) for p, k in zip(own, np.diff(offsets[first : end + 1]))]
                text = np.repeat(np.arange(first, end), [len(p) for p in own])
                place = np.concatenate(own)
                for i in range(0, len(place), HELD):
                    rows = around(text[i : i + HELD], place[i : i + HELD], data, offsets)
                    held.append((ids[rows[0]], ths[rows[0]], *rows[1:]))
                    n += len(rows[0])
                    if n >= HELD:
                        out += rows_of(*map(np.concatenate, zip(*held)))
                        held, n = [], 0
            if n:
                out += rows_of(*map(np.concatenate, zip(*held)))
        kinds = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("bytes", pa.binary())])
        return pa.Table.from_batches(out, kinds)

    def around(text, place, data, offsets):
        """(text, place, bytes before, bytes from it on, all of these bytes) of anchors that have enough around them."""
        left = np.minimum(place, reach)
        right = np.minimum(offsets[text + 1] - offsets[text] - place, match)
        whole = left + right >= match
        text, place, left, right = text[whole], place[whole], left[whole], right[whole]
        step = np.arange(-reach, match)
        ctx = np.empty((len(text), width), dtype=np.uint8)
        for i in range(0, len(text), 8192):
            s = slice(i, i + 8192)
            index = (offsets[text[s]] + place[s])[:, None] + step
            ctx[s] = data[np.clip(index, 0, len(data) - 1)]
            ctx[s][(step < -left[s][:, None]) | (step >= right[s][:, None])] = 0
        return text, place, left, right, ctx

    def rows_of(own, th, place, left, right, ctx):
        if len(own):
            part = np.searchsorted(cuts.value, ctx[:, reach : reach + 8].copy().view(">u8")[:, 0].astype(np.uint64), side="right")
            # equal surroundings in this run: all but the smallest id are covered for good
            flat = np.zeros((len(ctx), -(-(width + 2) // 8) * 8), dtype=np.uint8)
            flat[:, :width] = ctx
            flat[:, width], flat[:, width + 1] = left, right
            known = _least_owner(flat.view(np.uint64), own) < own
            yield spans_of(own[known], th[known], place[known], left[known], right[known])
            rows = np.flatnonzero(~known)
            rows = rows[np.argsort(part[rows], kind="stable")]
            cut = np.r_[np.flatnonzero(np.r_[True, np.diff(part[rows]) != 0][: len(rows)]), len(rows)]
            groups = [rows[i:j] for i, j in zip(cut[:-1], cut[1:])]
            packs = [zlib.compress(b"".join(c[g].astype(k).tobytes() for c, k in zip((own, th, place, left, right), KINDS)) + ctx[g].tobytes(), 6) for g in groups]
            none = pa.nulls(len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([int(part[g[0]]) for g in groups], pa.int32()), pa.array([len(g) for g in groups], pa.int64()), none, pa.array(packs, pa.binary())], names=names)

    def meet(batches):
        got = [[] for _ in range(6)]
        for batch in batches:
            part = np.asarray(batch.column(0))
            yield batch.filter(pa.array(part < 0)).select(names[1:])
            packs = batch.filter(pa.array(part >= 0))
            for n, pack in zip(packs.column(1).to_pylist(), packs.column(3).to_pylist()):
                b, at = zlib.decompress(pack), 0
                for g, k in zip(got, KINDS):
                    g.append(np.frombuffer(b, dtype=k, count=n, offset=at))
                    at += g[-1].nbytes
                got[5].append(np.frombuffer(b, dtype=np.uint8, offset=at).reshape(n, width))
        if got[0]:
            own, th, place, left, right, ctx = (np.concatenate(g) for g in got)
            got.clear()
            back, on = covered(ctx, left.astype(np.int64), right.astype(np.int64), own, match, gram)
            some = on > 0
            yield spans_of(own[some], th[some], place[some].astype(np.int64), back[some], on[some]).select(names[1:])

    def spans_of(own, th, place, back, on):
        """A row for each text, with its spans merged."""
        se = np.column_stack([place - back, place + on]).astype(np.int64)
        order = np.lexsort((th, own))
        own, th, se = own[order], th[order], se[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(th) != 0)][: len(own)])
        cut = np.r_[starts, len(own)]
        part = pa.array(np.full(len(starts), -1, dtype=np.int32))
        return pa.RecordBatch.from_arrays([part, pa.array(own[starts]), pa.array(th[starts]), pa.array([_merge(se[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], names=names)

    names = ["part", "id", "th", "bytes"]
    # a row is a text's spans (part -1), or surroundings of a range (their number stands for the id), packed
    both = docs.select("slice", "id", "th", "text").groupBy("slice").cogroup(places.groupBy("slice"))
    rows = both.applyInArrow(contexts, "part int, id long, th long, bytes binary")
    # spans that are known already go wherever their document's hash does
    rows = rows.withColumn("to", F.when(F.col("part") >= 0, F.col("part").cast("long")).otherwise(F.xxhash64("id")))
    found = rows.repartition(RANGES * parts, "to").drop("to").mapInArrow(meet, "id long, th long, bytes binary")

    def tidy(batches):
        for batch in batches:
            spans = [_merge(np.frombuffer(b"".join(s), dtype=np.int64).reshape(-1, 2)).tobytes() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, pa.binary())], names=["id", "th", "spans"])

    return written(found.groupBy("id", "th").agg(F.collect_list("bytes").alias("s")).mapInArrow(tidy, "id long, th long, spans binary"), "spans")


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, spans.

    Each byte that is covered by ``match`` bytes which also start in a document with a smaller id is
    removed; ``spans`` are the maximal removed stretches (``start:end``, comma-joined). Null and empty
    texts have no bytes. Rows with one id aren't earlier or later than each other; null ids stand
    after all others. Other columns are ignored.
    """
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("th", F.xxhash64("text"))  # tells rows with one id apart
    spans = repeated_spans(d.select("id", "th", "text"), match, gram, sample_docs)
    joined = d.join(small_side(spans), ["id", "th"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], []]
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                b = t.encode("utf-8", "surrogatepass")
                se = [(i, j) for i, j in np.frombuffer(s or b"", dtype=np.int64).reshape(-1, 2).tolist() if i < len(b)]
                se = [(i, min(j, len(b))) for i, j in se]
                at, kept = 0, hashlib.sha256()
                for i, j in se:
                    kept.update(b[at:i])
                    at = j
                kept.update(b[at:])
                for c, v in zip(cols, (len(b), sum(j - i for i, j in se), len(se), kept.hexdigest(), ",".join(f"{i}:{j}" for i, j in se))):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    id_type = d.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
