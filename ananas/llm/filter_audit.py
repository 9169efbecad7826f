"""Filter interaction audit: which filter removes a document under every order of the filters.

A document's row of the mask matrix has 0 where it fails a filter and "never" elsewhere; a column
of the position matrix (the inverse of an order) has the step at which the order applies each
filter. Their min-plus product is the removal step: the least position among the failed filters.
Documents only count by (part, mask, labels), so the product is taken once for each of at most
2^filters masks of a part, weighted by how many documents have that mask.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ananas.llm.shared import split_words

SPACES = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 of a text (null: empty): A under 200 words, B under half of the words distinct,
    C over 3 % capitals, D holds a symbol of ``#$%&*|``. A text without words fails A alone."""
    text = F.coalesce(text, F.lit(""))
    words = split_words(text, SPACES)
    n, capitals = F.size(words).cast("long"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [
        n < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        100 * capitals > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a language fail which of the five filters.

    ``good`` and ``toxic`` are how many of the n have a label row with quality or toxic of 1. Bit 4
    (E) marks a text that a row with a smaller id has too; equal texts are those of equal SHA-256.
    Null language: part ''. Null text: empty, so equal to an empty one. A null id is smaller than
    none and has no label, so such a row never fails E; rows that repeat an id and its text all
    count, and none of them is a copy of another. Several labels of an id: any that is 1 counts.

    Equal rows are summed before each shuffle, so a text that a third of all documents share is a
    row for each language and label when its copies meet. Rows without an id are dealt by their text.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"),
        text_mask(F.col("text")).alias("mask"),
    ).withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("h")).otherwise(F.lit(0).cast("long")))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    same = ["h", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("doc_id", "salt", *same).agg(F.count("*").alias("n"))
    # of equal rows the smallest id, how often it is there, and how many rows have an id
    held = F.col("doc_id").isNotNull()
    rows = rows.groupBy(*same).agg(
        F.min(F.when(held, F.struct("doc_id", "n"))).alias("first"),
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("with_id"),
    )
    # over the languages and labels of one text: a row each
    rows = rows.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("h")))
    originals = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.col("with_id") - originals
    either = F.array(F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), copies.alias("n")))
    out = rows.select("part", "good", "toxic", F.explode(either).alias("x")).select("part", "x.mask", "x.n", "good", "toxic").filter("n > 0")
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removal_table(masks: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """Counts of every part, order of the filters and step, zeros included.

    ``masks`` has (part, mask, n, good, toxic), bit k of the mask for ``letters[k]``. A part has
    at most 2^filters masks, so this grows with the number of parts alone. No rows: no result.
    """
    k, never = len(letters), len(letters) + 1
    orders = F.array(*[
        F.struct(F.lit("".join(o)).alias("filter_order"), F.array(*[F.lit(o.index(x) + 1) for x in letters]).alias("at"))
        for o in itertools.permutations(letters)
    ])
    cost = F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, 0).otherwise(never) for i in range(k)])
    rows = masks.withColumn("cost", cost).select("*", F.explode(orders).alias("o")).select("part", "mask", "cost", "n", "good", "toxic", "o.*")
    rows = rows.withColumn("removal", F.array_min(F.zip_with("cost", "at", lambda a, b: a + b)))
    rows = rows.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("step", F.col("at")[F.col("filter")])
    bit = F.expr("shiftleft(1, filter)")
    gone, fails = F.col("removal") == F.col("step"), F.col("mask").bitwiseAND(bit) > 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    table = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("removal") > F.col("step")).alias("kept"),
        total(gone).alias("removed"),
        total(fails & (F.col("removal") < F.col("step"))).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(gone, "good").alias("good_lost"),
        total(gone, "toxic").alias("toxic_lost"),
    )
    share = F.sum("removed").over(Window.partitionBy("part", "filter"))  # over the orders
    return table.withColumn("shapley", share).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The table of ``removal_table`` for the five filters over whole texts; see ``document_masks`` for
    nulls, empty and repeated rows. Other columns of ``docs`` and ``labels`` are not looked at."""
    return removal_table(document_masks(docs, labels))
