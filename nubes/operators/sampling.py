"""Splits, quotas and replacements of rows.

Random choices follow the md5 of an id and a seed: any engine repeats them, however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.plans.ordered import order_statistics, ranked


def shuffled(df: DataFrame, keys: list[str], ident: str, seed: int, rank: str = "place") -> DataFrame:
    """``df`` with its place, from 1, in a random order among the rows of the same keys."""
    h = F.md5(F.concat_ws("|", F.col(ident), F.lit(str(seed))))
    return ranked(df.withColumn("h_", h), keys, ["h_", ident], rank).drop("h_")


def group_split(df: DataFrame, group: str, seed: int = 0, shares: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """``df`` with ``part`` (dev, val, test): all rows of a group in one part; sizes rounded half to even.

    Needs three groups or more and no empty part.  Null groups get a null part.
    """
    if len(shares) != 3 or min(shares) <= 0 or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must be three positive numbers that sum to 1")
    ids = shuffled(df.select(F.col(group).alias("g_")).where("g_ IS NOT NULL").distinct(), [], "g_", seed)
    n = ids.count()
    dev, val = round(n * shares[0]), round(n * shares[1])
    if n < 3 or dev < 1 or val < 1 or dev + val >= n:
        raise ValueError(f"{n} groups don't fill three parts")
    part = F.when(F.col("place") <= dev, "dev").when(F.col("place") <= dev + val, "val").otherwise("test")
    return df.join(ids.select("g_", part.alias("part")), F.col(group) == F.col("g_"), "left").drop("g_")


def group_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 500) -> DataFrame:
    """``df`` with ``fold`` from 0: groups dealt in random order, the first n mod folds parts one larger."""
    ids = shuffled(df.select(F.col(group).alias("g_")).where("g_ IS NOT NULL").distinct(), [], "g_", seed)
    n = ids.count()
    if n < folds:
        raise ValueError(f"{n} groups for {folds} folds")
    size, more = divmod(n, folds)
    at = F.col("place") - 1
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / size)).cast("int")
    return df.join(ids.select("g_", fold.alias("fold")), F.col(group) == F.col("g_"), "left").drop("g_")


def class_balanced(df: DataFrame, label: str, ident: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, equally many of each label, the first n mod k labels one more; raises where a label has too few."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(label).collect()  # a row per class
    size, more = divmod(n, max(1, len(sizes)))
    quotas = {r[0]: size + (i < more) for i, r in enumerate(sizes)}
    short = [r[0] for r in sizes if r[1] < quotas[r[0]]]
    if short or not sizes:
        raise ValueError(f"too few rows of the labels {short}")
    quota = F.element_at(F.create_map(*(F.lit(v) for kv in quotas.items() for v in kv)), F.col(label))
    return shuffled(df.where(F.col(label).isNotNull()), [label], ident, seed).where(F.col("place") <= quota).drop("place")


def replaced(pairs: DataFrame, alpha: float, seed: int = 0) -> DataFrame:
    """From (pid, x, y) with one row per position: (pid, x, replaced) with y in the first round(alpha * n) positions of a
    random order.  Larger alphas keep the replacements of smaller ones."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    many = round(alpha * pairs.count())
    rows = shuffled(pairs, [], "pid", seed).withColumn("replaced", F.col("place") <= many)
    return rows.select("pid", F.when(F.col("replaced"), F.col("y")).otherwise(F.col("x")).alias("x"), "replaced")


def length_bins(df: DataFrame, length: str, bins: int = 10) -> tuple[DataFrame, list[float]]:
    """``df`` with ``bin`` from 0 by linear quantiles of all lengths; equal edges leave bins empty."""
    edges = df.agg(F.percentile(F.col(length).cast("double"), F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("e")).first().e
    if edges is None:
        raise ValueError("no lengths")
    number = sum((F.when(F.col(length) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.withColumn("bin", number.cast("int")), edges


def length_matched(df: DataFrame, kind: str, length: str, ident: str, bins: int = 10, most: int | None = None, seed: int | None = None) -> DataFrame:
    """Equally many rows of kinds 'correct' and 'hallucinated' in every length bin.

    Without a seed the first by (length, ident) are taken, with one a random choice.  ``most`` bounds a side: quotas shrink in
    proportion, largest remainders first, then smaller bins.
    """
    rows, _ = length_bins(df.where(F.col(kind).isin("correct", "hallucinated") & F.col(length).isNotNull()), length, bins)
    counts = {(r["bin"], r[kind]): r["count"] for r in rows.groupBy("bin", kind).count().collect()}  # at most 2 * bins rows
    quota = {b: min(counts.get((b, k), 0) for k in ("correct", "hallucinated")) for b in range(bins)}
    total = sum(quota.values())
    if not total:
        raise ValueError("no length bin has both kinds")
    if most is not None and total > most:
        scaled = {b: q * most / total for b, q in quota.items()}
        quota = {b: int(s) for b, s in scaled.items()}
        for b in sorted(scaled, key=lambda b: (int(scaled[b]) - scaled[b], b))[: most - sum(quota.values())]:
            quota[b] += 1
    by = [kind, "bin"]
    rows = ranked(rows, by, [length, ident], "place") if seed is None else shuffled(rows, by, ident, seed)
    limit = F.element_at(F.array(*(F.lit(quota[b]) for b in range(bins))), F.col("bin") + 1)
    return rows.where(F.col("place") <= limit).drop("place")


def shuffled_labels(df: DataFrame, label: str, ident: str, seed: int = 0) -> DataFrame:
    """``df`` with ``label`` permuted over its rows: the i-th row in order of ids takes the label of the i-th in random order."""
    rows = ranked(df, [], [ident], "place")
    given = shuffled(df.select(F.col(ident).alias("i_"), F.col(label).alias("given_")), [], "i_", seed).drop("i_")
    return rows.join(given, "place").withColumn(label, F.col("given_")).select(*df.columns)


def null_halves(df: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """``df`` with ``side``: n random rows for P from even positions in order of ids, n for Q from odd ones."""
    rows = ranked(df, [], [ident], "row_").withColumn("side", F.when(F.col("row_") % 2 == 1, "P").otherwise("Q"))
    return shuffled(rows, ["side"], ident, seed).where(F.col("place") <= n).drop("place", "row_")


def packet(df: DataFrame, kind: str, ident: str, n: int, alpha: float, seed: int = 0) -> DataFrame:
    """(side, position, kind, item): P and Q of n items each.  P and Q's correct items are disjoint; round(alpha * n) random
    positions of Q hold hallucinated items, nested in alpha."""
    place = shuffled(df.where(F.col(kind).isin("correct", "hallucinated")), [kind], ident, seed)
    sizes = {r[kind]: r["count"] for r in place.groupBy(kind).count().collect()}
    if sizes.get("correct", 0) < 2 * n or sizes.get("hallucinated", 0) < n:
        raise ValueError("a packet needs 2 n correct and n hallucinated items")
    c = place.where(F.col(kind) == "correct")
    p = c.where(F.col("place") <= n).select(F.lit("P").alias("side"), "place", F.col(kind).alias("kind"), F.col(ident).alias("item"))
    both = c.where(F.col("place").between(n + 1, 2 * n)).select((F.col("place") - n).alias("pid"), F.struct(F.lit("correct").alias("kind"), F.col(ident).alias("item")).alias("x"))
    h = place.where((F.col(kind) == "hallucinated") & (F.col("place") <= n)).select(F.col("place").alias("pid"), F.struct(F.lit("hallucinated").alias("kind"), F.col(ident).alias("item")).alias("y"))
    q = replaced(both.join(h, "pid"), alpha, seed + 1).select(F.lit("Q"), "pid", "x.kind", "x.item")
    return p.unionAll(q).withColumnRenamed("place", "position")


def percent_edges(df: DataFrame, keys: list[str], value: str, q: float, way: str = "higher") -> DataFrame:
    return order_statistics(df, keys, value, {"edge": (q, way)})
