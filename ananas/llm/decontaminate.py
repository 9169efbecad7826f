"""Benchmark decontamination: prefix-filtered set join of item windows against documents.

Both sides are cut into shingles of ``SHINGLE`` words. A window (13 consecutive words of an
item) can only occur where its rarest shingle does, so that one shingle is its necessary prefix:
document shingles meet it in an equi-join, the position gives the only possible start, length
and position bounds drop starts outside the document, and the window is accepted when all its
shingles, compared word by word, stand at their offsets. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananas.llm.shared import BROADCAST_BYTES, ascii_lower, measured_bytes, split_words, written

WINDOW = 13
SHINGLE = 5
#: What lies between words once A-Z are lower-cased (fixed by the contract of the query).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def words_of(col: Column) -> Column:
    return split_words(ascii_lower(col), GAPS)


def _runs(words: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words, by position."""
    n = F.size(words)
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(F.col(words), i, F.lit(size))))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(windows: wid, words, size, m; membership: wid, item), windows distinct by their words."""
    w = items.select("item", words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    n = F.size("words")
    w = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.slice("words", i, F.lit(window)))).alias("words")).distinct()
    w = written(w.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("wid"), "*"), "windows")
    n = F.size("words")
    size = F.least(n, F.lit(shingle))
    return w.select("wid", "words", n.alias("len"), size.alias("size"), (n - size + 1).alias("m")), w.select("wid", F.explode("items").alias("item"))


def occurrences(docs: DataFrame, shingles: DataFrame, sizes: list[int], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Where the item ``shingles`` (sid, hash, words, size) stand in ``docs`` (doc_id, text), in one pass.

    Rows: row, doc_id, th (hash of the text), n_words, sid, pos (from 0). Each document has one more row with sid -1, so
    that the pass also returns the documents without any. The shingles are broadcast in blocks of
    at most ``limit`` measured bytes; a larger benchmark takes more passes, never a larger broadcast.
    """
    blocks = max(1, math.ceil(measured_bytes(shingles) / limit))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("th"))
    if blocks > 1:
        docs = written(docs, "documents")
    d = docs.select("row", "doc_id", "th", words_of(F.col("text")).alias("words"))
    runs = [_runs("words", s) for s in sizes]
    d = d.select("row", "doc_id", "th", "words", F.concat(*runs, F.array(F.lit(0).cast("long"))).alias("hashes"))
    # outer: a plain explode would compute the array once more, to test that it isn't empty
    d = d.select("row", "doc_id", "th", "words", F.posexplode_outer("hashes").alias("at", "hash"))
    n = F.size("words")
    # the runs of each size follow one another; the last entry is the document's own
    pos, size, first = F.col("at"), F.lit(0), F.lit(0)
    for s in sizes:
        count = F.greatest(n - s + 1, F.lit(0))
        inside = F.col("at") >= first
        pos, size, first = F.when(inside, F.col("at") - first).otherwise(pos), F.when(inside, F.lit(s)).otherwise(size), first + count
    last = F.col("at") >= first
    d = d.select("row", "doc_id", "th", n.alias("n_words"), "words", pos.alias("pos"), F.when(last, F.lit(0)).otherwise(size).alias("size"), "hash")

    def block(k: int) -> DataFrame:
        s = shingles.filter(F.pmod("hash", F.lit(blocks)) == k) if blocks > 1 else shingles
        s = s.select("sid", F.col("hash").alias("h"), F.col("size").alias("s"), F.col("words").alias("sw"))
        if k == 0:
            s = s.union(s.sparkSession.sql("select -1L as sid, 0L as h, 0 as s, array('') as sw"))
        same = (F.col("hash") == F.col("h")) & (F.col("size") == F.col("s")) & ((F.col("s") == 0) | (F.slice("words", F.col("pos") + 1, F.greatest("s", F.lit(1))) == F.col("sw")))
        return d.join(F.broadcast(s), same).select("row", "doc_id", "th", "n_words", "sid", "pos")

    return written(reduce(DataFrame.union, [block(k) for k in range(blocks)]), "occurrences")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, limit: int = BROADCAST_BYTES, key: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit when it lies inside an occurrence of an item's window; a document is contaminated
    when at least one word in ``share`` is hit. Null and empty texts have no words and no hits.
    Repeated rows and repeated or null ids are judged row by row. Items without words match nothing,
    items with a null id are left out, and repeated items count once. Other columns are ignored.
    With ``key`` the hash of the text (``th``) is returned, too.
    """
    items = items.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
    wins, members = item_windows(items, window, shingle)
    at = F.sequence(F.lit(0), F.col("m") - 1)
    parts = wins.select("wid", "len", "m", "size", F.explode(F.transform(at, lambda i: F.struct(i.alias("off"), F.slice("words", i + 1, F.col("size")).alias("words")))).alias("p")).select("wid", "len", "m", "size", "p.off", "p.words")
    shingles = written(parts.groupBy("words", "size").agg(F.count("*").alias("uses")).select(F.monotonically_increasing_id().alias("sid"), F.xxhash64("words").alias("hash"), "words", "size"), "shingles")
    parts = written(parts.join(shingles, ["words", "size"]).select("wid", "len", "m", "off", "sid"), "window_shingles")
    sizes = [r["size"] for r in shingles.select("size").distinct().collect()]  # at most `shingle` numbers
    occ = occurrences(docs.select("doc_id", "text"), shingles, sorted(sizes, reverse=True), limit)
    found = occ.filter("sid >= 0").select("row", "n_words", "sid", "pos")

    # the rarest shingle of a window is its prefix; a window with a shingle that no document has can't occur
    count = found.groupBy("sid").agg(F.count("*").alias("n"))
    prefix = parts.join(count, "sid").groupBy("wid", "len", "m").agg(F.min(F.struct("n", "sid", "off")).alias("p"), F.count("*").alias("known")).filter("known = m").select("wid", "len", "m", "p.sid", "p.off")
    start = F.col("pos") - F.col("off")
    cand = found.join(prefix, "sid").select("row", "wid", "len", "m", start.alias("start"), "n_words").filter("start >= 0 and start + len <= n_words").drop("n_words")

    due = cand.join(parts.select("wid", "off", "sid"), "wid").select("row", "wid", "len", "m", "start", (F.col("start") + F.col("off")).alias("pos"), "sid")
    hits = due.join(found.drop("n_words"), ["row", "pos", "sid"]).groupBy("row", "wid", "len", "m", "start").agg(F.count("*").alias("n")).filter("n = m")
    hits = written(hits.select("row", "wid", "start", (F.col("start") + F.col("len")).alias("end")), "hits")

    span = F.sort_array(F.collect_set(F.struct("start", "end")))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(span, zero, lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("hit"), F.greatest(s["end"], x["end"]).alias("end")))
    by_row = hits.groupBy("row").agg(covered["hit"].cast("long").alias("n_hit"))
    found_items = hits.select("row", "wid").distinct().join(members, "wid").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = occ.filter("sid = -1").select("row", "doc_id", "th", F.col("n_words").cast("long").alias("n_words")).join(by_row, "row", "left").join(found_items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", *["th"] * key, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.concat_ws(",", "items"), 256), F.lit(EMPTY_SHA)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
