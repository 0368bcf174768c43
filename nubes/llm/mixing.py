"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) divided by its quality weight, with u from the MD5 of its id, so reruns
agree.  A source's target is spent first on complete epochs over all its documents; what is left goes to documents in key
order until their summed sizes reach it, and the last one is taken in part.

No source is sorted whole.  Keys fall into ``RANGES`` fixed key ranges; sizes summed per source and range show the one range
where the budget ends, and only that range is ordered.  Ranges below it are taken, ranges above are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubes.plans.scratch import Scratch

RANGES = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Quality weight of a document labelled 1, labelled 0, not labelled.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def words_in(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, labels: DataFrame, *extra: str) -> DataFrame:
    """doc_id, source, size, sampling key ``k`` and the ``extra`` columns of every row.

    ``k`` is in [0, 1): the exponential key e mapped to e / (1 + e), which keeps its order.
    """
    quality = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min("quality").alias("quality"))
    )
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), *extra)
    # 13 hex digits of MD5 as a fraction; the half step keeps it off 0 and 1
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    u = (digits + 0.5) / F.lit(float(1 << 52))
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(UNKNOWN)
    e = -F.log(u) / weight
    return (
        base.join(quality, base.doc_id == quality.labelled, "left")
        .select("doc_id", "source", "size", (e / (1 + e)).alias("k"), *extra)
        .withColumn("slot", F.least(F.floor(F.col("k") * RANGES), F.lit(RANGES - 1)).cast("int"))
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: shares of ``SHARE`` times all sizes by weight, capped at ``EPOCHS`` times the source.

    Capping and resharing has a closed form: with sources ordered by cap over weight, the level is the first budget over
    weight, less what the sources before take, that no cap stops.  The windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.lit(float(EPOCHS)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("rest", F.sum(F.col("source_size")).over(every) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.col("rest") / F.col("rest_weight")
    per = per.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", level.alias("at")))).over(every)["at"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, labels: DataFrame, *extra: str) -> DataFrame:
    """doc_id, size, source_size, target, the ``extra`` columns and taken for every row of ``docs`` (doc_id, source, text).

    ``taken`` counts words, repeats included: whole epochs times the size, plus the size once more for documents before the
    end of the budget, plus a part of the document at its end.  Null texts have size 0 and nothing is taken of them; null
    sources form one source, last in order; rows with equal ids tie in key and share their place in any order, so for
    repeated rows only the multiset of results is defined, unless ``extra`` columns tell them apart.  Labels that disagree count as the lower one.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.keep(sized(docs, labels, *extra), "sizes")
    targets = source_targets(sizes)
    goal = targets.select(
        F.col("source").alias("of"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(EPOCHS))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    by_slot = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        sizes.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
        .withColumn("before", F.coalesce(F.sum("slot_size").over(by_slot), F.lit(0)))
        .join(goal, F.col("source").eqNullSafe(F.col("of")))
        .where("before <= budget AND before + slot_size > budget")
        .select(F.col("of").alias("end_of"), F.col("slot").alias("end_slot"), F.col("before").alias("end_before"))
    )
    ends = scratch.keep(goal.join(slots, F.col("of").eqNullSafe(F.col("end_of")), "left").drop("end_of"), "ends")
    rows = sizes.join(ends, F.col("source").eqNullSafe(F.col("of")))
    at_end = F.col("slot").eqNullSafe(F.col("end_slot"))
    edge = rows.where(at_end)
    inside = Window.partitionBy("source").orderBy("k", "doc_id", "size", *extra).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("end_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    columns = ["doc_id", "size", "source_size", "target", *extra]
    edge = edge.withColumn("once", part).select(*columns, (F.col("epochs") * F.col("size") + F.col("once")).cast("long").alias("taken"))
    below = F.when(F.col("end_slot").isNull() & (F.col("budget") <= 0), 0).when(F.col("end_slot").isNull() | (F.col("slot") < F.col("end_slot")), F.col("size")).otherwise(0)
    rest = rows.where(~at_end).select(*columns, (F.col("epochs") * F.col("size") + below).cast("long").alias("taken"))
    return edge.unionAll(rest)


ORACLE = f"""
WITH lab AS (SELECT doc_id AS labelled, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
         CASE quality WHEN 1 THEN {GOOD}::DOUBLE WHEN 0 THEN {BAD}::DOUBLE ELSE {UNKNOWN}::DOUBLE END AS w
  FROM documents LEFT JOIN lab ON doc_id = labelled),
k AS (SELECT *, -ln(u) / w AS e FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][place % 3 + 1]::DOUBLE AS weight, {float(EPOCHS)}::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight
      FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest / rest_weight, (cap / weight, place)) AS level FROM r WHERE rest / rest_weight * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM r, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {EPOCHS}) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, CAST(round(g.target) AS BIGINT) - g.epochs * g.source_size AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.e / (1 + k.e), k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - start)) AS BIGINT) AS taken FROM p
"""
