"""The statistics layer: contrasts with a same-law control, power, false discovery, rank measures, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nubes.plans.ordered import average_ranks, order_statistics, parts_in_order, ranked, running

ALPHAS = (0.05, 0.10, 0.20)


def finite(c: Column) -> Column:
    """Spark's NaN is larger than any number, so tests of order need this beside them."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def is_similarity(metric: Column) -> Column:
    """Precision and recall get smaller as clouds part; other metrics get larger."""
    return metric.startswith("precision") | metric.startswith("recall")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, tie: list[str], alpha: float = 0.05) -> DataFrame:
    """``df`` with ``adjusted`` and ``reject``.  adjusted: the least p * m / rank from this rank on, at most 1.

    Families may be of any size: ranks and the minimum from the right are taken part by part.  p outside [0, 1], null or NaN
    is an error.
    """
    bad = F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)
    checked = df.withColumn(p, F.when(bad, F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double")).otherwise(F.col(p)))
    sizes = df.groupBy(*family).agg(F.count("*").alias("m_"))
    rows = ranked(checked, family, [p, *tie], "rank_").join(sizes, family)
    rows = parts_in_order(rows.withColumn("scaled_", F.col(p) * F.col("m_") / F.col("rank_")), family, ["rank_"])
    least = rows.groupBy("part_", *family).agg(F.min("scaled_").alias("least_"))
    # minima from the right as running minima of the mirrored order: a frame that shrinks would be computed anew for every row
    later = Window.partitionBy(*family).orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1)
    after = least.select("part_", *family, F.min("least_").over(later).alias("after_"))
    inside = Window.partitionBy("part_", *family).orderBy(F.desc("rank_")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("own_", F.min("scaled_").over(inside)).join(after, ["part_", *family])
    adjusted = F.least(F.col("own_"), F.coalesce("after_", F.lit(1.0)), F.lit(1.0))
    return out.withColumn("adjusted", adjusted).withColumn("reject", F.col("adjusted") <= alpha).select(*df.columns, "adjusted", "reject")


def contrast_table(values: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` (keys..., metric, kind, value): its rows that aren't control, with delta and z against the control of the
    same keys and metric.  Deltas are positive where a cloud is worse than the control; fewer than two finite control values
    give null."""
    by = [*keys, "metric"]
    control = values.where((F.col("kind") == "control") & finite(F.col("value")))
    base = control.groupBy(*by).agg(F.avg("value").alias("mu0"), F.stddev_samp("value").alias("sd0"), F.count("*").alias("n0"))
    rows = values.where("kind <> 'control'").join(base, by, "left")
    sign = F.when(is_similarity(F.col("metric")), -1.0).otherwise(1.0)
    delta = F.when(F.col("n0") >= 2, sign * (F.col("value") - F.col("mu0")))
    return rows.withColumn("delta", delta).withColumn("z", F.col("delta") / (F.col("sd0") + 1e-12)).drop("mu0", "sd0", "n0")


def power_table(values: DataFrame, keys: list[str], alphas: tuple[float, ...] = ALPHAS, alternative: str | None = None) -> DataFrame:
    """Empirical power for each key, metric and alpha: the share of effect values strictly beyond the control's order
    statistic.  A NaN effect is not a detection but counts; ``alternative`` None goes by the metric's direction.

    Two-sided thresholds take two columns.  Fewer than two control values give null figures.
    """
    by = [*keys, "metric"]
    control = values.where("kind = 'control'").select(*by, "value")
    levels = {}
    for i, a in enumerate(alphas):
        levels |= {f"up{i}": (1.0 - a, "higher"), f"down{i}": (a, "lower"), f"low{i}": (a / 2.0, "higher"), f"high{i}": (1.0 - a / 2.0, "higher")}
    base = control.groupBy(*by).agg(F.count("*").alias("n_control"), F.avg("value").alias("mean_control"), F.stddev_samp("value").alias("sd_control"))
    base = base.join(order_statistics(control, by, "value", levels), by)
    v, diff = F.col("value"), F.col("value") - F.col("mean_control")
    z = F.when(F.col("sd_control") == 0, F.when(diff == 0, 0.0).otherwise(float("inf"))).otherwise(diff / F.col("sd_control"))
    known = lambda c: F.when(~F.isnan(c), c)
    share = lambda test: F.avg(F.when(~F.isnan(v) & test, 1.0).otherwise(0.0))
    less = {None: is_similarity(F.col("metric")), "less": F.lit(True)}.get(alternative, F.lit(False))
    tests = []
    for i in range(len(alphas)):
        if alternative == "twosided":
            tests.append(share((v < F.col(f"low{i}")) | (v > F.col(f"high{i}"))).alias(f"power{i}"))
        else:
            tests.append(F.when(F.first(less), share(v < F.col(f"down{i}"))).otherwise(share(v > F.col(f"up{i}"))).alias(f"power{i}"))
    effect = values.where("kind = 'effect'").select(*by, "value").join(base, by)
    seen = effect.groupBy(*by).agg(F.count("*").alias("n_effect"), F.avg(known(v)).alias("mean_effect"), F.avg(known(z)).alias("z_mean_effect"), *tests)
    rows = seen.join(base, by)
    two = alternative == "twosided"
    cells = [
        F.struct(
            F.lit(float(a)).alias("alpha"), F.col(f"power{i}").alias("power"),
            (F.col(f"low{i}") if two else F.when(less, F.col(f"down{i}")).otherwise(F.col(f"up{i}"))).alias("threshold"),
            *([F.col(f"high{i}").alias("threshold_upper")] if two else []),
        )
        for i, a in enumerate(alphas)
    ]
    out = rows.select(*by, F.explode(F.array(*cells)).alias("c"), "n_control", "n_effect", "mean_control", "sd_control", "mean_effect", "z_mean_effect")
    return out.select(*by, "c.*", "n_control", "n_effect", "mean_control", "sd_control", "mean_effect", "z_mean_effect").withColumn("target_met", F.col("power") >= 0.8)


def least_n(power: DataFrame, target: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """(metric, min_n): the least n that meets the target at alpha; null for a metric that never does."""
    near = F.abs(F.col("alpha") - alpha) <= 1e-8 + 1e-5 * abs(alpha)
    return power.groupBy("metric").agg(F.min(F.when(near & (F.col("power") >= target), F.col("n"))).alias("min_n"))


def first_detected(steps: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys..., step, delta, ci_low), rows per repeat allowed: the first step whose interval lies above 0, the mean
    delta there and the share of repeats with a positive one.  No detection: nulls.  NaN never detects and counts as wrong."""
    low = F.col("ci_low")
    by = steps.groupBy(*keys, "step").agg(
        F.max(F.when(~F.isnan(low) & (low > 0), True).otherwise(False)).alias("found"), F.avg("delta").alias("delta"),
        F.avg(F.when(~F.isnan("delta") & (F.col("delta") > 0), 1.0).otherwise(0.0)).alias("direction_share"),
    )
    first = by.groupBy(*keys).agg(F.min(F.when(F.col("found"), F.struct("step", "delta", "direction_share"))).alias("at"))
    return first.select(*keys, "at.step", "at.delta", "at.direction_share")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys..., n, rho) over rows where both values are there; constant columns give null."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keys, F.col(x).alias("x_"), F.col(y).alias("y_"))
    r = average_ranks(average_ranks(both, keys, "x_", "rx"), keys, "y_", "ry")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop("rx", "ry") / spread).alias("rho"))


def detection_quality(df: DataFrame, keys: list[str], score: str, label: str, threshold: float) -> DataFrame:
    """(keys..., auroc, auprc, balanced_accuracy) of a score for labels 0/1.

    auroc by rank sums with ties halved; auprc as the sum of precision times the step of recall over distinct scores; both
    are null where one class is missing.
    """
    counts = df.groupBy(*keys, score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    upto = running(counts, keys, [F.col(score).desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = df.groupBy(*keys).agg(
        F.sum(label).alias("p_"), F.sum(1 - F.col(label)).alias("n_"),
        F.sum(F.when(F.col(score) >= threshold, F.col(label)).otherwise(0)).alias("tp_"), F.sum(F.when(F.col(score) < threshold, 1 - F.col(label)).otherwise(0)).alias("tn_"),
    )
    rows = upto.join(totals, keys)
    # each positive beats the negatives after it and ties with half of those beside it
    beats = F.sum(F.col("pos") * (F.col("n_") - F.col("fp") + F.col("neg") / 2.0))
    step = F.sum(F.col("pos") / F.col("p_") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p, n = F.first("p_"), F.first("n_")
    there = (p > 0) & (n > 0)
    return rows.groupBy(*keys).agg(
        F.when(there, beats / (p * n)).alias("auroc"), F.when(there, step).alias("auprc"),
        F.when(there, (F.first("tp_") / p + F.first("tn_") / n) / 2).alias("balanced_accuracy"),
    )


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction: some sqrt(max(a, b)) steps."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(1.0 - x, b, a)
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    m = 0
    while True:
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + top * d) or 1e-300)
            c = (1.0 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) * h / a


def binomial_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson: the shares at which a result at least, or at most, as large has half of what ``level`` leaves."""

    def at_least(p: float) -> float:
        return 1.0 if hits == 0 else beta_share(p, hits, n - hits + 1)

    def solve(f, goal: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < goal else (low, mid)
        return (low + high) / 2

    tail = (1 - level) / 2
    lower = 0.0 if hits == 0 else solve(at_least, tail)
    hits += 1
    return lower, 1.0 if hits > n else solve(at_least, 1 - tail)


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that is quick."""
    x, a, b = (np.asarray(v, np.float64) for v in np.broadcast_arrays(x, a, b))
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / keep(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        step = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / keep(1 + step * d), keep(1 + step / c)
        h *= d * c
        step = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / keep(1 + step * d), keep(1 + step / c)
        h *= d * c
        if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-15:
            break
    front = np.array([log_beta(i, j) for i, j in zip(p.ravel(), q.ravel())]).reshape(p.shape)
    with np.errstate(divide="ignore"):
        part = np.exp(p * np.log(y) + q * np.log1p(-y) - front) * h / p
    return np.where(turned, 1 - part, part)


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's law; NaN for NaN."""
    t, df = (np.asarray(v, np.float64) for v in np.broadcast_arrays(t, df))
    far = beta_share(df / (df + t * t), df / 2, np.full_like(df, 0.5)) / 2
    return np.where(t >= 0, far, 1 - far)


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The t with P(T <= t) = p, by halving; p from 0.5 up."""
    p, df = (np.asarray(v, np.float64) for v in np.broadcast_arrays(p, df))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(1100):
        short = t_tail(high, df) > 1 - p
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(80):
        mid = (low + high) / 2
        under = t_tail(mid, df) > 1 - p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(np.isnan(df), np.nan, (low + high) / 2)


def _of_columns(f, *columns: Column) -> Column:
    """``f`` of columns of doubles, in batches; null where any is null or the result is NaN."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        if known.any():
            out[known] = f(a.to_numpy(np.float64)[known], b.to_numpy(np.float64)[known])
        return pd.Series(out).where(~np.isnan(out), None)

    return run(*columns)


def t_tail_column(t: Column, df: Column) -> Column:
    return _of_columns(t_tail, t, df)


def t_quantile_column(p: Column, df: Column) -> Column:
    return _of_columns(t_quantile, p, df)


def welch_table(values: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """(keys..., metric, delta, se, df, ci_low, ci_high, p_value): the effect's mean less the control's, positive is worse, with Welch's
    degrees of freedom, interval and two-sided p.  A side with fewer than two values, or no variance on both, gives nulls."""
    by = [*keys, "metric"]
    side = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("value")))
    g = values.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*by)
    g = g.agg(*(side(kind, f).alias(f"{name}{i}") for i, kind in enumerate(("control", "effect")) for name, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    one, two = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    sign = F.when(is_similarity(F.col("metric")), -1.0).otherwise(1.0)
    g = g.withColumns({"delta": sign * (F.col("m1") - F.col("m0")), "se": F.nullif(F.sqrt(one + two), F.lit(0.0))})
    g = g.withColumn("df", (one + two) * (one + two) / F.nullif(one * one / (F.col("n0") - 1) + two * two / (F.col("n1") - 1), F.lit(0.0)))
    half = t_quantile_column(F.lit((1 + level) / 2), F.col("df")) * F.col("se")
    p = 2 * t_tail_column(F.abs(F.col("delta") / F.col("se")), F.col("df"))  # 1 at most
    return g.withColumn("half_", half).select(*by, "delta", "se", "df", (F.col("delta") - F.col("half_")).alias("ci_low"), (F.col("delta") + F.col("half_")).alias("ci_high"), p.alias("p_value"))


def two_sample_ks(df: DataFrame, side: str, value: str) -> DataFrame:
    """One row: the largest gap between the distribution functions of side 0 and side 1, and its asymptotic p-value."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("b"))
    upto = running(counts, [], ["v"], {"fa": F.col("a"), "fb": F.col("b")})
    top = upto.agg(F.max("fa").alias("na"), F.max("fb").alias("nb"))
    gap = upto.crossJoin(F.broadcast(top)).groupBy("na", "nb").agg(F.max(F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb"))).alias("ks_stat"))
    lam = F.col("ks_stat") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    series = sum(((-1) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 101))
    return gap.select("ks_stat", F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series))).alias("ks_p"))


def strong_level(rows: DataFrame, keys: list[str], level: str, z: str, limit: float = 3.0) -> DataFrame:
    """(keys..., first_level, max_z): the least level with |z| of ``limit`` or more, null where there is none, and the largest |z|."""
    size = F.abs(F.when(~F.isnan(z), F.col(z)))
    return rows.groupBy(*keys).agg(F.min(F.when(size >= limit, F.col(level))).alias("first_level"), F.max(size).alias("max_z"))


def joint_means(values: DataFrame, repeat: str, resamples: int, seed: int = 0) -> DataFrame:
    """(resample, metric, value): means of (repeat, metric, value) when repeats are drawn anew, the same draw for all metrics, so that they
    can be set against each other within a resample."""
    drawn = bootstrap_draws(values, repeat, resamples, seed).join(values, repeat)
    return drawn.groupBy("resample", "metric").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("value"))


def bootstrap_draws(groups: DataFrame, key: str, resamples: int, seed: int = 0) -> DataFrame:
    """(resample, key, times): whole groups drawn with replacement, as many as there are, for each resample.

    Draw i of resample r takes the group at place md5(seed|r|i) modulo the number of groups.  Joined to the rows by key, with
    ``times`` as a weight, pairs inside a group stay together and nothing is copied.
    """
    ids = ranked(groups.select(key).where(F.col(key).isNotNull()).distinct(), [], [key], "place")
    n = ids.count()
    draws = ids.select(F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"), F.col("place").alias("draw"))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "resample", "draw")), 1, 12), 16, 10).cast("long")
    draws = draws.select("resample", (F.pmod(code, F.lit(max(n, 1))) + 1).alias("place")).groupBy("resample", "place").agg(F.count("*").alias("times"))
    return draws.join(ids, "place").select("resample", key, "times")


def pair_signs(pairs: DataFrame, key: str, permutations: int, seed: int = 0) -> DataFrame:
    """(permutation, key, sign): +1 keeps the labels of a pair, -1 swaps them; a fair coin from md5(seed|permutation|key)."""
    many = pairs.select(key).distinct().withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    bit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "permutation", key)), 1, 1), 16, 10).cast("int") % 2
    return many.select("permutation", key, (1 - 2 * bit).alias("sign"))


def upper_tail_p(observed: Column, null: Column) -> Column:
    """(exceedances + 1) / (n + 1) of an aggregate over null values that never is 0."""
    return (F.sum(F.when(null >= observed, 1).otherwise(0)) + 1) / (F.count(null) + 1)
