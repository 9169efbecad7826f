"""Mixing sources to target weights: certain whole copies, then Pareto order sampling.

Each source gets a target of words. A document of a source is due ``target / source size``
copies: the whole part is given to all, and the fraction is the inclusion probability of one
more. Documents are ranked by the odds of a random number over the odds of that probability;
the sample takes ranks in order until the words that the source still lacks are reached, so
its size is fixed. The cut is found from sums over narrow rank ranges, and only the range that
holds it is put in order: no source is ever sorted or gathered as a whole. Only DataFrame
functions are used, and the draws come from ids and texts, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ananas.llm.shared import free_names, small_side, split_words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Documents that a rank range holds on average, at most.
RANGE_ROWS = 4096


def size_of(text: Column) -> Column:
    """Words between ASCII blanks (fixed by the contract of the query)."""
    return F.size(split_words(text, r"[\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from the id and the text: 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def measure(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id and source with size and draw ``u``."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, target): weights by code point of the source, null last, over and over.

    Targets stop at ``most`` times the source's size; the excess goes to the others by weight until
    none is above. In order of size over weight this is one cut, found from running sums over one
    row for each source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    s = s.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everyone)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the first source that isn't full gives the level of all that aren't
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(everyone)["level"])
    return s.select("source", "source_size", "n", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Odds of the draw over odds of the inclusion probability, mapped from (0, inf) to (0, 1)."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def _placed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "src")
    d = sized.join(small_side(plan), sized["source"].eqNullSafe(F.col("src")), "left").drop("src")
    return d.withColumn("rank", F.when(F.col("p") > 0, pareto_rank(F.col("u"), F.col("p"))))


def mix_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row a source: target, certain copies (whole), inclusion probability p, and the last rank taken
    as the rank range it lies in (cut_at) and the rank (cut).

    ``sized`` is a written table of ``measure``.
    """
    t = targets(sized, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("whole", F.floor(rate).cast("long"))
    t = t.withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size"))
    t = t.withColumn("p", F.when(F.col("source_size") > 0, F.col("lack") / F.col("source_size")).otherwise(F.lit(0.0)))
    t = written(t.withColumn("ranges", F.floor(F.col("n") / range_rows) + 1), "targets")
    d = _placed(sized, t).filter("p > 0").withColumn("at", F.floor(F.col("rank") * F.col("ranges")))
    by_range = d.groupBy("source", "at").agg(F.sum("size").alias("words"), F.first("lack").alias("lack"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    by_range = by_range.withColumn("before", F.coalesce(upto, F.lit(0)))
    # documents of the range in which the running sum passes what the source lacks; ties of a rank go together
    cross = by_range.filter("before <= lack and before + words > lack").select(F.col("source").alias("src"), F.col("at").alias("cross_at"), "before")
    inside = d.join(cross, d["source"].eqNullSafe(cross["src"]) & (d["at"] == cross["cross_at"])).groupBy("source", "at", "rank").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("lack").alias("lack"))
    run = F.sum("words").over(Window.partitionBy("source", "at").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("sum", F.col("before") + F.coalesce(run, F.lit(0)))
    # a rank is taken if that brings the sum nearer to the target
    cut = inside.groupBy("source", "at").agg(F.max(F.when(F.col("sum") + F.col("words") / 2 <= F.col("lack"), F.col("rank"))).alias("cut"))
    cut = cut.select(F.col("source").alias("src"), F.col("at").alias("cut_at"), "cut")
    out = t.join(cut, t["source"].eqNullSafe(cut["src"]), "left")
    return written(out.select("source", "source_size", "target", "whole", "p", "ranges", "cut_at", "cut"), "mix_plan")


def copies_of(docs: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """All columns of ``docs``, and ``copies`` (which replaces a column of that name)."""
    own = ("u", "source", "whole", "p", "ranges", "cut_at", "cut")
    u, source, *rest = free_names(docs, *own)
    p = plan.select(*[F.col(c).alias(free) for c, free in zip(own[1:], [source, *rest])])
    d = docs.withColumn(u, draw(F.col("doc_id"), F.col("text"), seed))
    d = d.join(small_side(p), d["source"].eqNullSafe(F.col(source)), "left")
    return d.withColumn("copies", _copies(*[F.col(c) for c in (u, *rest)])).select(*[c for c in docs.columns if c != "copies"], "copies")


def _copies(u: Column, whole: Column, p: Column, ranges: Column, cut_at: Column, cut: Column) -> Column:
    rank = F.when(p > 0, pareto_rank(u, p))
    at = F.floor(rank * ranges)
    return whole + F.when((at < cut_at) | ((at == cut_at) & (rank <= cut)), 1).otherwise(0).cast("long")


def apply_mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with source_size, target, copies and taken (words of all copies)."""
    d = _placed(sized, plan)
    d = d.withColumn("copies", _copies(*[F.col(c) for c in ("u", "whole", "p", "ranges", "cut_at", "cut")]))
    return d.withColumn("taken", F.col("copies") * F.col("size")).drop("whole", "p", "ranges", "cut_at", "cut", "rank", "u")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): size, source_size, target, copies, taken.

    Null texts have size 0. Null sources form one source, the last. Rows equal in id and text share
    a draw, so all of them are taken or none. Sources without words have target 0. Other columns of
    ``docs`` are ignored; an empty table gives an empty result.
    """
    sized = written(measure(docs, seed), "sized")
    return apply_mix(sized, mix_plan(sized, weights, share, most, range_rows))
