"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.llm import ann, bpe, jaccard, lines, mixing, negatives, paragraphs, pii, quality, secrets, suffixes, warc, whitening
from nubes.plans.scratch import Scratch

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archive(_table(spark, sf_dir, "pages"), Scratch(spark, "warc").root)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed and the digest of the text that is left, for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, short=True).select("doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), pii.train(pii.labelled_sentences(spark)))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per paragraph, or piece of a passage, with a copy or near copy: its document, kind, number, component, the kept one, and whether it goes."""
    groups = paragraphs.repeated_paragraphs(_table(spark, sf_dir, "documents"), passages=True)
    return groups.select(
        "doc_id", "kind", F.col("no").alias("unit"), "component", F.col("keeper.doc_id").alias("kept_doc_id"), F.col("keeper.no").alias("kept_unit"),
        F.expr("struct(doc_id, no) <> keeper").alias("removed"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("pmod(vec_id, 50) = 0"))


def op11_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight components of every usable row; a deviation beyond a long is null."""
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (op1_warc_archive, op2_quality_rules, op3_byte_bpe, op4_jaccard_join, op5_line_dedup, op6_personal_data, op7_paragraph_dedup, op8_secret_scan, op9_source_mix, op10_nearest_vectors, op11_whitened_vectors, op12_suffix_dedup, op13_hard_negatives)}
ORACLES = {"op1_warc_archive": warc.ORACLE, "op9_source_mix": mixing.ORACLE}
