"""The registered queries of the training-data operators, and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ananas.llm import decontaminate, filter_audit, hard_negatives, html_extract, langid, licenses, mixing, ngram_join, pq_dedup, secrets, suffix_dedup, toxicity, warc
from ananas.llm.oracle import oracle_sql  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3(spark, sf_dir):
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5(spark, sf_dir):
    return toxicity.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op7(spark, sf_dir):
    return pq_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8(spark, sf_dir):
    out = langid.learn_and_identify(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size(F.split("spans", ",")).cast("long").alias("n_spans"))


def op9(spark, sf_dir):
    records, payloads = warc.write_archive(_table(spark, sf_dir, "pages"))
    return warc.archive_index(records, payloads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op11(spark, sf_dir):
    return html_extract.learn_and_extract(_table(spark, sf_dir, "pages"))


def op12(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13(spark, sf_dir):
    return hard_negatives.mine_embeddings(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1,
        "op2_licenses": op2,
        "op3_secrets": op3,
        "op4_mix": op4,
        "op5_toxicity": op5,
        "op6_ngram_join": op6,
        "op7_embedding_dedup": op7,
        "op8_language": op8,
        "op9_warc": op9,
        "op10_suffix_dedup": op10,
        "op11_html_extraction": op11,
        "op12_filter_audit": op12,
        "op13_hard_negatives": op13,
        "pipeline": corpus_pipeline.run,
    }
