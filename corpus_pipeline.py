"""A training corpus from raw documents: good texts, no repeated lines, one of each near-duplicate group, mixed, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.llm import bpe, jaccard, lines, mixing, quality
from nubes.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: every repeated row by itself; null, empty and short texts go."""
    return quality.keep_good(docs.select(*COLUMNS), _labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines leave their documents; a document left without a word goes, and with it null and empty texts."""
    out = lines.dedup_lines(docs.select(*COLUMNS), short=True).where(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``row``, a number of each row's own, and ``hash`` of its text; written once, which settles the numbers."""
    numbers = {"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    return Scratch(docs.sparkSession, name).keep(docs.select(*COLUMNS).withColumns(numbers), "rows")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents the one with the smallest id stays; of equal ids that with the smallest text hash.

    Rows are told apart by a number of their own: rows that share an id go only where their texts are linked or equal.  A row
    with a null id is linked to nothing and stays; so does every row whose text is null, empty or without a word.  Texts of any
    length are read whole; an empty table gives an empty result.
    """
    rows = _numbered(docs, "similar")
    known = rows.where("doc_id IS NOT NULL")
    similar = jaccard.similar_documents(known.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("of"), "component_id")
    members = known.select("row", "doc_id", "hash").join(similar, F.col("row") == F.col("of"))
    keep = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return known.join(keep, "row", "left_semi").select(*COLUMNS).unionAll(rows.where("doc_id IS NULL").select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, cut to whole words where it takes a part.

    Rows of size 0 (null and empty texts) are not taken; null sources are one source; rows with a null id take part, and rows that
    share an id are ordered by the hash of their text, so reruns agree.  An empty table gives an empty result.
    """
    docs = _numbered(docs, "mixed")
    taken = mixing.mix_sources(docs, _labels(spark, sf_dir), "hash", "row").where("taken > 0").select(F.col("row").alias("of"), "size", "taken")
    rows = docs.join(taken, F.col("row") == F.col("of")).withColumn("words", F.explode(F.expr("concat(array_repeat(size, int(taken div size)), filter(array(taken % size), x -> x > 0))")))
    # the first words of a text: every word with the white space before it
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every row; null texts count as empty, repeated rows each have theirs."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]
#: Hashed n-gram ratios, edit distances and merges have no SQL form; tests/llm/test_pipeline.py compares the run with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
