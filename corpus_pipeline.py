"""Corpus pipeline: five stages over ``documents``, each the work of one operator of ``ananas.llm``.

Each stage takes what its predecessor kept, writes Parquet into the shared folder and hands on
the columns of documents; the last adds how many copies the mix takes.

Null, empty, repeated rows: a document without a letter goes at the first stage, so null and
empty texts end there; of rows that are equal in id and text, one stays at the second; a null id
is kept like any other until then. Extra columns of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ananas.llm import decontaminate, langid, mixing, ngram_join, secrets
from ananas.llm.shared import free_names, small_side, written


def _kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that agree with one of ``gone`` (id, th) in id and hash of the text."""
    ident, th = free_names(docs, "id", "th")
    gone = small_side(written(gone.select(F.col("id").alias(ident), F.col("th").alias(th)).distinct(), "gone"))
    same = docs["doc_id"].eqNullSafe(gone[ident]) & (F.xxhash64(docs["text"]) == gone[th])
    return docs.join(gone, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones have taught; those without a letter go."""
    return langid.reject_unknown(docs, langid.train(docs.select("text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_first(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words or more lies in windows of benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items, key=True)
    return _kept(docs, found.filter("contaminated").select(F.col("doc_id").alias("id"), "th"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts and count ``n_chars`` anew; no document goes."""
    return secrets.redact(docs, secrets.train(secrets.labelled_strings(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``; the others go."""
    sized = written(mixing.measure(docs), "sized")
    plan = mixing.mix_plan(sized)
    return mixing.copies_of(docs, plan).filter("copies > 0")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secret_spans),
    ("source_mix", mix),
]

#: SQL can express neither the trained models of the stages nor their masks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
