"""Group folds, models of all folds from one pass, and rates by level with intervals over groups."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubes.functions.statistics import bootstrap_draws
from nubes.operators.clouds import merged
from nubes.operators.pools import grouped_moments
from nubes.operators.trials import intervals
from nubes.plans.ordered import ranked


def balanced_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``df`` with ``fold``: whole groups, the largest first, go to the folds to and fro, so that folds differ by about one group.
    Rows without a group have none."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("of_")).agg(F.count("*").alias("size_"))
    place = F.pmod(F.col("place_") - 1, F.lit(2 * folds))
    dealt = ranked(sizes, [], [F.desc("size_"), "of_"], "place_").select("of_", F.when(place < folds, place).otherwise(2 * folds - 1 - place).cast("int").alias("fold"))
    return df.join(dealt, F.col(group) == F.col("of_"), "left").drop("of_")


def ridge_out_of_fold(rows: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> DataFrame:
    """``rows`` with predicted and base: a ridge regression of the target on standardised features, and the target's mean, both from all
    folds but the row's own.  Rows with a null or NaN in any of them are left out.

    One pass gives the moments of every fold; those of all others are sums of them.  Each fold's model is a handful of numbers.
    """
    used = [F.col(c).cast("double") for c in (*features, target)]
    known = rows.where(reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c) for c in used)) & F.col("fold").isNotNull())
    parts = {r.fold: (r.n, np.array(r["mean"]), np.array(r.m2).reshape(len(used), -1)) for r in grouped_moments(known.select("fold", F.array(*used).alias("x")), ["fold"]).collect()}
    predicted: Column = F.lit(None).cast("double")
    base: Column = F.lit(None).cast("double")
    for fold in parts:
        n, mean, m2 = reduce(merged, (part for other, part in sorted(parts.items()) if other != fold), (0, None, None))
        if not n:
            continue
        d = len(features)
        sd = np.sqrt(np.diag(m2)[:d] / n)
        sd = np.where(sd > 0, sd, 1.0)
        weights = np.linalg.solve(m2[:d, :d] / np.outer(sd, sd) + penalty * np.eye(d), m2[:d, d] / sd)
        value = sum((F.lit(float(w)) * ((c - F.lit(float(m))) / F.lit(float(s))) for w, c, m, s in zip(weights, used, mean, sd)), F.lit(float(mean[d])))
        predicted = F.when(F.col("fold") == fold, value).otherwise(predicted)
        base = F.when(F.col("fold") == fold, F.lit(float(mean[d]))).otherwise(base)
    return known.withColumns({"predicted": predicted, "base": base}).where("predicted IS NOT NULL")


def rates_by_level(rows: DataFrame, level: str, group: str, values: dict[str, Column], resamples: int = 200, seed: int = 0) -> DataFrame:
    """(level, name, n, mean, ci_low, ci_high): means of some columns at every level, with percentile intervals when whole groups are
    drawn anew; ``mean`` is that of the rows themselves.

    Draws weigh each group's sums, so rows are read once whatever the number of resamples.
    """
    cells = [F.struct(F.lit(name).alias("name"), c.cast("double").alias("v")) for name, c in values.items()]
    long = rows.select(F.col(level).alias("level"), F.col(group).alias(group), F.explode(F.array(*cells)).alias("c")).select("level", group, "c.name", "c.v").where("v IS NOT NULL")
    sums = long.groupBy("level", "name", group).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    drawn = bootstrap_draws(rows, group, resamples, seed).join(sums, group).groupBy("resample", "level", "name")
    drawn = drawn.agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("value"))
    ends = intervals(drawn, ["level", "name"]).select("level", "name", "ci_low", "ci_high")
    own = sums.groupBy("level", "name").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return own.join(ends, ["level", "name"])
