"""Many two-sample comparisons over one pass of the pair relation.

A trial is a pair of weighted subsets of one pool of points: relabelled sides, resampled clouds, subsamples.  What depends on
pairs (sums of distances or of kernel values) is bilinear in the weights, so a block pair is reduced to three numbers a trial by
two matrix products, however many trials there are; pairs are computed once and never leave their task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubes.operators.clouds import Sums, blocks, itself, near_squared, pair_blocks
from nubes.plans.ordered import order_statistics, ranked

#: Weights that a task keeps for the parts it has seen.
WEIGHTS = 1 << 24


def draw(*parts) -> F.Column:
    """A number in 0 .. 2**32 - 1 from the md5 of the parts, which any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def weighted(points: DataFrame, weights: DataFrame) -> DataFrame:
    """(pid, x, codes, ws) from rows (pid, trial, side, w) with side p or q: a point's weights as sparse lists, the code being twice the
    trial, plus one for q.  Points without a weight are left out."""
    code = (F.col("trial") * 2 + F.when(F.col("side") == "q", 1).otherwise(0)).cast("int")
    each = weights.groupBy("pid", code.alias("code")).agg(F.sum("w").cast("double").alias("w"))
    each = each.groupBy("pid").agg(F.collect_list(F.struct("code", "w")).alias("of"))
    return points.join(each, "pid").select("pid", "x", F.col("of.code").alias("codes"), F.col("of.w").alias("ws"))


def dense(codes: np.ndarray, ws: np.ndarray, trials: int) -> tuple[np.ndarray, np.ndarray]:
    """(wp, wq), points x trials, of sparse lists."""
    out = np.zeros((len(codes), 2 * trials))
    if len(codes):
        out[np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.concatenate(list(codes))] = np.concatenate(list(ws))
    return out[:, ::2], out[:, 1::2]


def trial_sums(points: DataFrame, trials: int, *gammas: float | None) -> DataFrame:
    """(trial, np, nq and, for gamma number k, pp_k, qq_k, pq_k) of ``weighted`` points: total weights; sums over pairs of weight
    products times the distance, or times exp(-gamma d^2) where gamma is not None, pairs of a point with itself counted.  One pass over
    the pairs, whatever the number of gammas."""
    n = points.count()
    names = [f"{c}_{k}" for k in range(len(gammas)) for c in ("pp", "qq", "pq")]

    class Kernel(Sums):
        def __init__(self):
            super().__init__(self.pair)
            self.weights = {}

        def of(self, ids, of):
            """A part's weights, made once a task."""
            key = ids.tobytes()
            if key not in self.weights:
                if sum(len(w[0]) for w in self.weights.values()) * trials > WEIGHTS:
                    self.weights.clear()
                self.weights[key] = dense(of["codes"], of["ws"], trials)
            return self.weights[key]

        def pair(self, a, x, of_a, b, y, of_b):
            d2 = near_squared(x, y)
            (ap, aq), (bp, bq) = self.of(a, of_a), self.of(b, of_b)
            out = []
            for gamma in gammas:
                d = np.sqrt(d2) if gamma is None else np.exp(-gamma * d2)
                to_p, to_q = d @ bp, d @ bq
                pp, qq, pq = (ap * to_p).sum(axis=0), (aq * to_q).sum(axis=0), (ap * to_q).sum(axis=0)
                if not itself(a, b):  # each pair of parts comes once
                    pp, qq, pq = 2 * pp, 2 * qq, pq + (aq * to_p).sum(axis=0)
                out += [pp, qq, pq]
            return dict(zip(names, out))

        def rest(self):
            for out in super().rest():
                yield {"trial": np.arange(trials, dtype=np.int32)} | out

    dealt = blocks(points, n, "codes", "ws")
    schema = ", ".join(["trial int", *(f"{c} double" for c in names)])
    sums = pair_blocks(dealt, dealt, n, Kernel, schema, halved=True, gathers=True).groupBy("trial").agg(*(F.sum(c).alias(c) for c in names))
    cells = points.select(F.explode(F.arrays_zip("codes", "ws")).alias("c")).select((F.col("c.codes") / 2).cast("int").alias("trial"), (F.col("c.codes") % 2 == 0).alias("of_p"), F.col("c.ws").alias("w"))
    of = lambda side, v: F.sum(F.when(F.col("of_p") == side, v).otherwise(0.0))
    w = F.col("w")
    sizes = cells.groupBy("trial").agg(of(True, w).alias("np"), of(False, w).alias("nq"))
    return sizes.join(sums, "trial")


def _energy(k: int) -> F.Column:
    means = [F.col(f"pq_{k}") / (F.col("np") * F.col("nq")), F.col(f"pp_{k}") / (F.col("np") * F.col("np")), F.col(f"qq_{k}") / (F.col("nq") * F.col("nq"))]
    return 2 * means[0] - means[1] - means[2]


def _mmd(k: int) -> F.Column:
    n, m = F.col("np"), F.col("nq")
    # a point's pairs with itself: w of w * w, whose kernel is 1, are those of one and the same drawn point
    inside = (F.col(f"pp_{k}") - n) / (n * (n - 1)) + (F.col(f"qq_{k}") - m) / (m * (m - 1))
    return F.sqrt(F.greatest(F.lit(0.0), inside - 2 * F.col(f"pq_{k}") / (n * m)))


def trial_energy(points: DataFrame, trials: int) -> DataFrame:
    """(trial, value): 2 mean d(P,Q) - mean d(P,P) - mean d(Q,Q) of every trial, zero diagonals included."""
    return trial_sums(points, trials, None).select("trial", _energy(0).alias("value"))


def trial_mmd(points: DataFrame, trials: int, gamma: float) -> DataFrame:
    """(trial, value): the root of the unbiased squared discrepancy, 0 at least.  A point drawn w times counts as w points, which are
    at distance 0 from each other."""
    return trial_sums(points, trials, gamma).select("trial", _mmd(0).alias("value"))


def trial_energy_mmd(points: DataFrame, trials: int, gamma: float) -> DataFrame:
    """(metric, trial, value) of ``trial_energy`` and ``trial_mmd``, from one pass over the pairs."""
    cells = [F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in (("energy", _energy(0)), ("mmd", _mmd(1)))]
    return trial_sums(points, trials, None, gamma).select("trial", F.explode(F.array(*cells)).alias("c")).select("c.metric", "trial", "c.value")


def relabelled(pool: DataFrame, n_p: int, permutations: int, seed: int) -> DataFrame:
    """(pid, trial, side, w) of trial 0, the pool's own sides (even ids are P), and of ``permutations`` relabellings that keep both sizes."""
    own = pool.select("pid", F.lit(0).alias("trial"), F.when(F.col("pid") % 2 == 0, "p").otherwise("q").alias("side"))
    many = pool.select("pid").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    many = ranked(many.withColumn("h_", F.md5(F.concat_ws("|", "pid", F.lit(seed), "trial"))), ["trial"], ["h_", "pid"], "place")
    return own.unionByName(many.select("pid", "trial", F.when(F.col("place") <= n_p, "p").otherwise("q").alias("side"))).withColumn("w", F.lit(1))


def permutation_table(values: DataFrame, similar: tuple[str, ...] = ()) -> DataFrame:
    """metric, observed, null_mean, null_sd (ddof 0), z and p from (metric, trial, value), trial 0 being observed: the share of
    relabellings at least as far out, the observation counted.  Measures of similarity, whose names begin as one of ``similar``, get
    smaller as clouds part, so their tail is the lower one."""
    seen = values.where("trial = 0").select("metric", F.col("value").alias("observed"))
    null = values.where("trial > 0").join(seen, "metric")
    low = reduce(lambda a, b: a | b, (F.col("metric").startswith(s) for s in similar), F.lit(False))
    far = 1e-12 * F.greatest(F.abs("observed"), F.lit(1.0))  # equal values can differ in their last bits
    beyond = F.when(low, F.col("value") <= F.col("observed") + far).otherwise(F.col("value") >= F.col("observed") - far)
    out = null.groupBy("metric", "observed").agg(
        F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"), ((F.sum(beyond.cast("int")) + 1.0) / (F.count("*") + 1.0)).alias("p"),
    )
    return out.select("metric", "observed", "null_mean", "null_sd", ((F.col("observed") - F.col("null_mean")) / F.greatest("null_sd", F.lit(1e-12))).alias("z"), "p")


def resampled(cloud: DataFrame, side: str, n: int, resamples: int, seed: int) -> DataFrame:
    """(pid, trial, side, w): each resample draws n of the cloud's n points with replacement."""
    places = ranked(cloud.select("pid"), [], ["pid"], "place")
    spark = cloud.sparkSession
    draws = spark.range(resamples).select(F.col("id").cast("int").alias("trial")).crossJoin(F.broadcast(spark.range(1, n + 1).withColumnRenamed("id", "j")) if n < 100_000 else spark.range(1, n + 1).withColumnRenamed("id", "j"))
    draws = draws.select("trial", (F.pmod(draw(F.lit(side), F.lit(seed), "trial", "j"), F.lit(n)) + 1).alias("place"))
    counts = draws.groupBy("trial", "place").agg(F.count("*").alias("w"))
    return counts.join(places, "place").select("pid", "trial", F.lit(side).alias("side"), "w")


def intervals(values: DataFrame, keys: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """mean, ci_low, ci_high and width for each key: order statistics at ``low`` (rounded down) and ``high`` (rounded up)."""
    ends = order_statistics(values, keys, "value", {"ci_low": (low, "lower"), "ci_high": (high, "higher")})
    return values.groupBy(*keys).agg(F.avg("value").alias("mean")).join(ends, keys).withColumn("width", F.col("ci_high") - F.col("ci_low"))


def subsampled(p: DataFrame, q: DataFrame, sizes: list[int], repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Weights (pid, trial, side, w) over ``pooled(p, q)`` and the trials (trial, n, kind, repeat) of a power study.

    A control takes 2 n points of P in hash order, the first n against the rest; an effect takes n of P against n of Q.
    """
    spark = p.sparkSession
    rows = [(t, n, kind, r) for t, (n, kind, r) in enumerate((n, kind, r) for n in sizes for kind in ("control", "effect") for r in range(repeats))]
    trials = spark.createDataFrame(rows, "trial int, n int, kind string, repeat int")
    top = max(sizes)

    def places(cloud: DataFrame, doubled: F.Column, keep: int) -> DataFrame:
        """The first ``keep`` points of every trial; only a task's own first ones leave it."""
        many = cloud.select(doubled.alias("pid")).crossJoin(F.broadcast(trials.select("trial")))
        order = Window.partitionBy("trial").orderBy(F.md5(F.concat_ws("|", "pid", F.lit(seed), "trial")), "pid")
        return many.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)

    one = places(p, F.col("pid") * 2, 2 * top).join(F.broadcast(trials), "trial")
    one = one.where(F.col("place") <= F.when(F.col("kind") == "control", 2 * F.col("n")).otherwise(F.col("n"))).withColumn("side", F.when(F.col("place") <= F.col("n"), "p").otherwise("q"))
    two = places(q, F.col("pid") * 2 + 1, top).join(F.broadcast(trials), "trial").where((F.col("kind") == "effect") & (F.col("place") <= F.col("n"))).withColumn("side", F.lit("q"))
    return one.unionByName(two).select("pid", "trial", "side", F.lit(1).alias("w")), trials
