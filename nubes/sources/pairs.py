"""Question-answer pairs: reading, the canonical form, audits, hashes of id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ["knowledge", "question", "right_answer", "hallucinated_answer"]
SEPARATOR = "\x1f"
_EDGES = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def stripped(c: Column) -> Column:
    """Without white space at both ends, other spaces than ASCII ones included."""
    return F.regexp_replace(c, _EDGES, "")


def is_empty(c: Column) -> Column:
    return F.coalesce(stripped(c), F.lit("")) == ""


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+")), F.lit(0)).cast("long")


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character; broken lines raise, or are left out if not ``strict``."""
    head = spark.read.text(path).limit(1).first()
    many_lines = head is not None and head[0].lstrip()[:1] == "["
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", many_lines).option("mode", mode).json(path)


def prompt_id(knowledge: Column, question: Column) -> Column:
    """SHA-1 of both texts, stripped, with a rare separator; null counts as empty."""
    part = lambda c: F.coalesce(stripped(c), F.lit(""))
    return F.sha1(F.concat(part(knowledge), F.lit(SEPARATOR), part(question)))


def canonical(raw: DataFrame, order: str, source: str, drop_empty: bool = True, drop_repeated: bool = False) -> DataFrame:
    """prompt_id, prompt, correct_answer, hallucinated_answer, category, source, knowledge and ``order``.

    ``drop_empty`` drops rows whose question or an answer is blank; ``drop_repeated`` keeps the first row of a prompt by
    ``order``, as a minimum per prompt and a join, so a prompt of any number of rows is no hot group.
    """
    missing = [c for c in RAW if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = raw.select(
        prompt_id(F.col("knowledge"), F.col("question")).alias("prompt_id"), F.col("question").alias("prompt"), F.col("right_answer").alias("correct_answer"),
        "hallucinated_answer", F.lit("qa").alias("category"), F.lit(source).alias("source"), "knowledge", order,
    )
    if drop_empty:
        rows = rows.where(~(is_empty(F.col("prompt")) | is_empty(F.col("correct_answer")) | is_empty(F.col("hallucinated_answer"))))
    if drop_repeated:
        first = rows.groupBy("prompt_id").agg(F.min(order).alias(order))
        rows = rows.join(first, ["prompt_id", order], "left_semi")
    return rows


def audit(pairs: DataFrame) -> DataFrame:
    """One row: counts of empty, equal and repeated fields, and the lengths' means and quartiles."""
    c, h, p = F.col("correct_answer"), F.col("hallucinated_answer"), F.col("prompt")
    length = lambda x: F.coalesce(F.length(x), F.lit(0))
    rows = pairs.select(
        "prompt_id", is_empty(p).alias("ep"), is_empty(c).alias("ec"), is_empty(h).alias("eh"),
        (~is_empty(c) & (stripped(c) == F.coalesce(stripped(h), F.lit("")))).alias("same"),
        length(c).alias("cc"), length(h).alias("hc"), word_count(c).alias("cw"), word_count(h).alias("hw"),
    )
    ids = pairs.groupBy("prompt_id").count().agg(F.count("*").alias("n_unique_prompt_ids"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicate_prompt_ids"))
    repeated = lambda x, name: pairs.groupBy(F.coalesce(stripped(x), F.lit(""))).count().where("count > 1").agg(F.count("*").alias(name))
    figures = []
    for name, x in (("correct_chars", F.col("cc")), ("hallucinated_chars", F.col("hc")), ("correct_words", F.col("cw")), ("hallucinated_words", F.col("hw")), ("diff_chars", F.col("hc") - F.col("cc")), ("diff_words", F.col("hw") - F.col("cw"))):
        figures += [F.round(F.avg(x), 6).alias(f"{name}_mean"), F.round(F.stddev_samp(x), 6).alias(f"{name}_std"), F.min(x).cast("long").alias(f"{name}_min"), F.round(F.percentile(x, 0.5), 6).alias(f"{name}_median"), F.max(x).cast("long").alias(f"{name}_max")]
    one = rows.agg(
        F.count("*").alias("n_rows"), F.count_if("ep").alias("n_empty_prompt"), F.count_if("ec").alias("n_empty_correct"), F.count_if("eh").alias("n_empty_hallucinated"),
        F.count_if(~F.col("ec") & ~F.col("eh")).alias("n_with_both_answers"), F.count_if("same").alias("n_correct_equals_hallucinated"),
        F.count_if(F.col("hc") > F.col("cc")).alias("n_longer"), F.count_if(F.col("hc") < F.col("cc")).alias("n_shorter"), F.count_if(F.col("hc") == F.col("cc")).alias("n_equal"), *figures,
    )
    for more in (ids, repeated(c, "n_duplicate_correct_answers"), repeated(h, "n_duplicate_hallucinated_answers")):
        one = one.crossJoin(F.broadcast(more))
    return one


def id_set_digest(df: DataFrame, column: str, repeats: bool = True) -> str:
    """SHA-256 over the sorted ids joined by newlines; ``repeats`` False counts each once.

    Ids arrive in order, partition by partition; the hash runs over the stream, so no node holds the list.
    """
    import hashlib

    ids = df.select(F.col(column).cast("string").alias("id")).where("id IS NOT NULL")
    h, first = hashlib.sha256(), True
    for row in (ids if repeats else ids.distinct()).orderBy("id").toLocalIterator():
        h.update(("" if first else "\n").encode() + row.id.encode())
        first = False
    return h.hexdigest()


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often, in any order."""
    two = two.select(*one.columns)
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def layer_indices(n_layers: int, fractions: list[float]) -> list[int]:
    """Layers at fractions of the depth, rounded half to even, each once."""
    return sorted({round(f * n_layers) for f in fractions})


def pooled_span(vectors: DataFrame, mode: str = "mean") -> DataFrame:
    """From (item, position, x, start, stop): (item, x) as the mean over the span's tokens, or its last token's vector."""
    inside = vectors.where("position >= start AND position < stop")
    if mode == "last":
        return inside.groupBy("item").agg(F.max_by("x", "position").alias("x"))
    cells = inside.select("item", F.posexplode("x").alias("i", "v")).groupBy("item", "i").agg(F.avg("v").alias("v"))
    return cells.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("x"))
