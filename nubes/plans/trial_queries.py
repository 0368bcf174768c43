"""Queries of many comparisons at once, over P and Q of the table ``embeddings``: permutation test, bootstrap, power, all metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nubes.functions.statistics import least_n, power_table
from nubes.operators import clouds, fused, metrics, trial_neighbours, trials
from nubes.plans.cloud_queries import _CELL, _CTE, _POOL, ORACLES as CLOUDS, pair, r9
from nubes.plans.scratch import Scratch
from nubes.sources.block_runs import BlockRun

PERMUTATIONS, RESAMPLES, SEED = 20, 20, 42
SIZES, REPEATS, STRETCH = [20, 40, 80], 10, 1.5


def permutation_test(spark, sf_dir):
    """Energy distance of P and Q against relabelled pools."""
    p, q = pair(spark, sf_dir)
    pool = clouds.pooled(p, q)
    weights = trials.relabelled(pool, p.count(), PERMUTATIONS, SEED)
    out = trials.permutation_table(trials.trial_energy(trials.weighted(pool, weights), PERMUTATIONS + 1).withColumn("metric", F.lit("energy")))
    return out.select(r9("observed").alias("observed"), r9("null_mean").alias("null_mean"), r9("null_sd").alias("null_sd"), F.round("z", 6).alias("z"), r9("p").alias("p"))


def bootstrap_interval(spark, sf_dir):
    """Percentile interval of the energy distance when both clouds are drawn anew."""
    p, q = pair(spark, sf_dir)
    even, odd = clouds.pooled(p, q.limit(0)), clouds.pooled(p.limit(0), q)
    weights = trials.resampled(even, "p", p.count(), RESAMPLES, SEED).unionByName(trials.resampled(odd, "q", q.count(), RESAMPLES, SEED))
    values = trials.trial_energy(trials.weighted(clouds.pooled(p, q), weights), RESAMPLES).withColumn("metric", F.lit("energy"))
    return trials.intervals(values, ["metric"]).select("metric", *(r9(c).alias(c) for c in ("mean", "ci_low", "ci_high", "width")))


def _all_values(pool, weights, count):
    """(metric, trial, value) of every metric but the topological ones; the kernel's width is that of the whole pool in every trial."""
    points = Scratch(pool.sparkSession, "trials").keep(trials.weighted(pool, weights), "points")
    gamma = 1.0 / max(clouds.median_distance(pool) ** 2, fused.GAMMA_FLOOR)
    near = trial_neighbours.trial_neighbours(points, count, (1, 3, 10), 5)
    # tables of values are read several times, the passes over the pairs behind them must run once
    return Scratch(pool.sparkSession, "trials").keep(near.unionByName(trials.trial_energy_mmd(points, count, gamma)), "values")


def permutation_metrics(spark, sf_dir):
    """Every metric but the topological ones against relabelled pools."""
    p, q = pair(spark, sf_dir)
    pool = clouds.pooled(p, q)
    values = _all_values(pool, trials.relabelled(pool, p.count(), PERMUTATIONS, SEED), PERMUTATIONS + 1)
    out = trials.permutation_table(values, similar=("precision", "recall"))
    return out.select("metric", *(F.round(c, 8).alias(c) for c in ("observed", "null_mean", "null_sd")), F.round("z", 5).alias("z"), r9("p").alias("p"))


def bootstrap_metrics(spark, sf_dir):
    """Percentile intervals of the same metrics when both clouds are drawn anew."""
    p, q = pair(spark, sf_dir)
    even, odd = clouds.pooled(p, q.limit(0)), clouds.pooled(p.limit(0), q)
    weights = trials.resampled(even, "p", p.count(), RESAMPLES, SEED).unionByName(trials.resampled(odd, "q", q.count(), RESAMPLES, SEED))
    values = _all_values(clouds.pooled(p, q), weights, RESAMPLES)
    return trials.intervals(values, ["metric"]).select("metric", *(F.round(c, 8).alias(c) for c in ("mean", "ci_low", "ci_high", "width")))


def power_values(spark, sf_dir):
    """Q is stretched by ``STRETCH``, since both clouds of the table follow one law."""
    p, q = pair(spark, sf_dir)
    q = q.select("pid", F.transform("x", lambda v: v * STRETCH).alias("x"))
    weights, plan = trials.subsampled(p, q, SIZES, REPEATS, SEED)
    values = trials.trial_energy(trials.weighted(clouds.pooled(p, q), weights), len(SIZES) * 2 * REPEATS)
    return values.join(plan, "trial").select("n", "kind", "repeat", F.lit("energy").alias("metric"), r9("value").alias("value"))


def empirical_power_values(spark, sf_dir):
    """Energy distances of control and effect pairs at every size."""
    return power_values(spark, sf_dir)


def power_blocks(spark, sf_dir):
    """The same values as a run of a block for each size and kind, broken off after the first size and taken up again."""
    values = Scratch(spark, "power").keep(power_values(spark, sf_dir), "values")
    path = Scratch(spark, "run").path("power")
    blocks = [{"n": n, "kind": kind} for n in SIZES for kind in ("control", "effect")]
    compute = lambda b: values.where((F.col("n") == b["n"]) & (F.col("kind") == b["kind"]))
    params = {"seed": SEED, "repeats": REPEATS, "stretch": STRETCH}
    for some in (blocks[:2], blocks):
        with BlockRun(spark, path, ["n", "kind"], params) as run:
            states = run.run(some, compute)
    if [s["status"] for s in states] != ["kept"] * 2 + ["ok"] * 4:
        raise RuntimeError(f"blocks were not resumed: {states}")
    return run.frame("repeat int, metric string, value double, n int, kind string").select("n", "kind", "repeat", "metric", "value")


def empirical_power(spark, sf_dir):
    """Power at every size and alpha from those pairs."""
    out = power_table(power_values(spark, sf_dir), ["n"])
    return out.select("n", "metric", "alpha", r9("power").alias("power"), r9("threshold").alias("threshold"), "target_met")


def empirical_min_n(spark, sf_dir):
    return least_n(power_table(power_values(spark, sf_dir), ["n"]))


def all_metrics(spark, sf_dir):
    """The metrics of one wide row that SQL can express; ``all_metrics_wide`` has them all."""
    row = metrics.compute_all(*pair(spark, sf_dir), skip=("mtd", "ntd", "rtd", "frechet"))
    return row.select(*(r9(c).alias(c) for c in row.columns))


def all_metrics_wide(spark, sf_dir):
    row = metrics.compute_all(*pair(spark, sf_dir))
    return row.select(*(r9(c).alias(c) for c in row.columns))


QUERIES = {f.__name__: f for f in (permutation_test, bootstrap_interval, permutation_metrics, bootstrap_metrics, empirical_power_values, power_blocks, empirical_power, empirical_min_n, all_metrics, all_metrics_wide)}

_ENERGY = """v AS (SELECT t.trial, 2 * max(pq) / (max(np) * max(nq)) - max(pp) / (max(np) * max(np)) - max(qq) / (max(nq) * max(nq)) AS value FROM (
    SELECT a.trial, sum(CASE WHEN a.side = 'p' AND b.side = 'p' THEN a.w * b.w * d END) AS pp, sum(CASE WHEN a.side = 'q' AND b.side = 'q' THEN a.w * b.w * d END) AS qq,
      sum(CASE WHEN a.side = 'p' AND b.side = 'q' THEN a.w * b.w * d END) AS pq FROM w a JOIN w b ON a.trial = b.trial JOIN dist ON dist.i = a.pid AND dist.j = b.pid GROUP BY a.trial) t
  JOIN (SELECT trial, sum(CASE WHEN side = 'p' THEN w END)::DOUBLE AS np, sum(CASE WHEN side = 'q' THEN w END)::DOUBLE AS nq FROM w GROUP BY trial) s ON s.trial = t.trial GROUP BY t.trial)"""
_DIST = ", dist AS (SELECT a.pid AS i, b.pid AS j, list_distance(a.x, b.x) AS d FROM pool a, pool b)"
_RANKED = """, w AS (SELECT pid, 0 AS trial, CASE WHEN pid % 2 = 0 THEN 'p' ELSE 'q' END AS side, 1 AS w FROM pool UNION ALL
  SELECT pid, trial, CASE WHEN row_number() OVER (PARTITION BY trial ORDER BY md5(concat_ws('|', pid, {seed}, trial)), pid) <= (SELECT count(*) FROM p) THEN 'p' ELSE 'q' END, 1
  FROM pool, range(1, {n} + 1) t(trial))""".format(seed=SEED, n=PERMUTATIONS)
_DRAWN = ", w AS (" + " UNION ALL ".join(
    f"""SELECT pid, trial, '{side}' AS side, count(*) AS w FROM (SELECT trial, ('0x' || substr(md5(concat_ws('|', '{side}', {SEED}, trial, j)), 1, 8))::BIGINT % (SELECT count(*) FROM {side}) + 1 AS place
      FROM range({RESAMPLES}) t(trial), range(1, (SELECT count(*) FROM {side}) + 1) u(j)) JOIN (SELECT pid, row_number() OVER (ORDER BY pid) AS place FROM pool WHERE pid % 2 = {odd}) USING (place) GROUP BY 1, 2"""
    for side, odd in (("p", 0), ("q", 1))
) + ")"
_PLAN = ", ".join(f"({t}, {n}, '{kind}', {r})" for t, (n, kind, r) in enumerate((n, kind, r) for n in SIZES for kind in ("control", "effect") for r in range(REPEATS)))
_SUB = f""", plan(trial, n, kind, repeat) AS (VALUES {_PLAN}),
  placed AS (SELECT pid, plan.*, row_number() OVER (PARTITION BY trial, pid % 2 ORDER BY md5(concat_ws('|', pid, {SEED}, trial)), pid) AS place FROM pool, plan),
  w AS (SELECT pid, trial, CASE WHEN pid % 2 = 1 OR place > n THEN 'q' ELSE 'p' END AS side, 1 AS w FROM placed
    WHERE CASE WHEN kind = 'control' THEN pid % 2 = 0 AND place <= 2 * n ELSE place <= n END)"""
_STRETCHED = f", pool AS (SELECT pid * 2 AS pid, x FROM p UNION ALL SELECT pid * 2 + 1, list_transform(x, lambda v: v * {STRETCH}::DOUBLE) FROM q)"
_VALUES = f"{_CTE}{_STRETCHED}{_DIST}{_SUB}, {_ENERGY}, long AS (SELECT n, kind, repeat, 'energy' AS metric, round(value, 9) AS value FROM v JOIN plan USING (trial))"
_POWER = _VALUES + """, c AS (SELECT n, list_sort(list(value)) AS vs FROM long WHERE kind = 'control' GROUP BY n),
  pow AS (SELECT l.n, a.alpha, vs[CAST(ceil((len(vs) - 1) * (1.0::DOUBLE - a.alpha)) AS INT) + 1] AS threshold, avg(CAST(value > vs[CAST(ceil((len(vs) - 1) * (1.0::DOUBLE - a.alpha)) AS INT) + 1] AS INT)) AS power
    FROM long l JOIN c ON c.n = l.n, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha) WHERE kind = 'effect' GROUP BY 1, 2, 3)"""



def _log_radius(side: str, k: int, group: str) -> str:
    """Sum of w * ln(distance to the k-th neighbour among points of ``side``) over points of ``group``, by trial; copies count."""
    return f"""SELECT a.trial, sum(a.w * ln(greatest(r.d, 1e-12::DOUBLE))) AS s, sum(a.w) AS n FROM {group} a JOIN (
        SELECT trial, pid, min(CASE WHEN upto >= {k} THEN d END) AS d FROM (
          SELECT a.trial, a.pid, e.d, sum(b.w - CASE WHEN a.pid = b.pid THEN 1 ELSE 0 END) OVER (PARTITION BY a.trial, a.pid ORDER BY e.d, b.pid) AS upto
          FROM {group} a JOIN {side} b ON a.trial = b.trial JOIN dist e ON e.i = a.pid AND e.j = b.pid) GROUP BY 1, 2) r ON r.trial = a.trial AND r.pid = a.pid GROUP BY a.trial"""


_SIDES = ", wp AS (SELECT * FROM w WHERE side = 'p'), wq AS (SELECT * FROM w WHERE side = 'q'), wa AS (SELECT pid, trial, sum(w) AS w FROM w GROUP BY ALL)"


def _covered(k: int, own: str, other: str) -> str:
    """Weighted share of ``other`` within the k-NN balls of ``own``, by trial."""
    return f"""SELECT trial, sum(CASE WHEN c THEN w ELSE 0 END)::DOUBLE / sum(w) AS value FROM (SELECT b.trial, b.pid, any_value(b.w) AS w, bool_or(e.d <= r.d + 1e-12::DOUBLE) AS c FROM {other} b JOIN (
        SELECT trial, pid, min(CASE WHEN upto >= {k} THEN d END) AS d FROM (
          SELECT a.trial, a.pid, e.d, sum(b.w - CASE WHEN a.pid = b.pid THEN 1 ELSE 0 END) OVER (PARTITION BY a.trial, a.pid ORDER BY e.d, b.pid) AS upto
          FROM {own} a JOIN {own} b ON a.trial = b.trial JOIN dist e ON e.i = a.pid AND e.j = b.pid) GROUP BY 1, 2) r ON r.trial = b.trial JOIN dist e ON e.i = r.pid AND e.j = b.pid GROUP BY 1, 2) GROUP BY trial"""


def _entropy_of(n: str, s: str, k: int = 5, d: int = 64) -> str:
    volume = 0.5 * d * math.log(math.pi) - math.lgamma(0.5 * d + 1.0)
    return f"((SELECT sum(1.0::DOUBLE / i) FROM range(1, CAST({n} AS BIGINT)) t(i)) - {sum(1.0 / i for i in range(1, k))!r}::DOUBLE + {volume!r}::DOUBLE + {d} * {s} / {n})"


_EVERY = f"""{_SIDES}, gam AS (SELECT 1.0::DOUBLE / greatest(median(d) ** 2, 1e-12::DOUBLE) AS gamma FROM dist WHERE i < j),
  sizes AS (SELECT trial, sum(CASE WHEN side = 'p' THEN w END)::DOUBLE AS np, sum(CASE WHEN side = 'q' THEN w END)::DOUBLE AS nq FROM w GROUP BY trial),
  kern AS (SELECT a.trial, sum(CASE WHEN a.side = 'p' AND b.side = 'p' THEN a.w * b.w * exp(-gamma * d * d) END) AS pp, sum(CASE WHEN a.side = 'q' AND b.side = 'q' THEN a.w * b.w * exp(-gamma * d * d) END) AS qq,
    sum(CASE WHEN a.side = 'p' AND b.side = 'q' THEN a.w * b.w * exp(-gamma * d * d) END) AS pq FROM w a JOIN w b ON a.trial = b.trial JOIN dist ON dist.i = a.pid AND dist.j = b.pid, gam GROUP BY a.trial),
  lp AS ({_log_radius('wp', 5, 'wp')}), lq AS ({_log_radius('wq', 5, 'wq')}), la AS ({_log_radius('wa', 5, 'wa')}),
  every AS (SELECT 'energy' AS metric, trial, value FROM v
    UNION ALL SELECT 'mmd', trial, sqrt(greatest(0.0::DOUBLE, (pp - np) / (np * (np - 1)) + (qq - nq) / (nq * (nq - 1)) - 2 * pq / (np * nq))) FROM kern JOIN sizes USING (trial)
    UNION ALL SELECT 'js', lp.trial, greatest(0.0::DOUBLE, {_entropy_of('la.n', 'la.s')} - ({_entropy_of('lp.n', 'lp.s')} + {_entropy_of('lq.n', 'lq.s')}) / 2) / ln(2.0::DOUBLE) FROM lp JOIN lq ON lp.trial = lq.trial JOIN la ON la.trial = lp.trial
    {' '.join(f"UNION ALL SELECT '{name}_{k}', trial, value FROM ({_covered(k, own, other)})" for k in (1, 3, 10) for name, own, other in (('precision', 'wp', 'wq'), ('recall', 'wq', 'wp')))})"""

ORACLES = {
    "permutation_metrics": f"""{_CTE}{_POOL}{_DIST}{_RANKED}, {_ENERGY}{_EVERY}, o AS (SELECT metric, value AS observed FROM every WHERE trial = 0)
      SELECT metric, round(observed, 8) AS observed, round(avg(value), 8) AS null_mean, round(stddev_pop(value), 8) AS null_sd, round((observed - avg(value)) / greatest(stddev_pop(value), 1e-12::DOUBLE), 5) AS z,
        round((sum(CASE WHEN CASE WHEN metric LIKE 'precision%' OR metric LIKE 'recall%' THEN value <= observed + 1e-12::DOUBLE * greatest(abs(observed), 1) ELSE value >= observed - 1e-12::DOUBLE * greatest(abs(observed), 1) END THEN 1 ELSE 0 END) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE), 9) AS p
      FROM every JOIN o USING (metric) WHERE trial > 0 GROUP BY metric, observed""",
    "bootstrap_metrics": f"""{_CTE}{_POOL}{_DIST}{_DRAWN}, {_ENERGY}{_EVERY}, s AS (SELECT metric, list_sort(list(value)) AS vs, avg(value) AS mean FROM every GROUP BY metric),
      e AS (SELECT metric, mean, vs[CAST(floor((len(vs) - 1) * 0.025::DOUBLE) AS INT) + 1] AS lo, vs[CAST(ceil((len(vs) - 1) * 0.975::DOUBLE) AS INT) + 1] AS hi FROM s)
      SELECT metric, round(mean, 8) AS mean, round(lo, 8) AS ci_low, round(hi, 8) AS ci_high, round(hi - lo, 8) AS width FROM e""",
    "permutation_test": f"""{_CTE}{_POOL}{_DIST}{_RANKED}, {_ENERGY}, o AS (SELECT value AS observed FROM v WHERE trial = 0)
      SELECT round(observed, 9) AS observed, round(avg(value), 9) AS null_mean, round(stddev_pop(value), 9) AS null_sd,
        round((observed - avg(value)) / greatest(stddev_pop(value), 1e-12::DOUBLE), 6) AS z, round((sum(CASE WHEN value >= observed THEN 1 ELSE 0 END) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE), 9) AS p
      FROM v, o WHERE trial > 0 GROUP BY observed""",
    "bootstrap_interval": f"""{_CTE}{_POOL}{_DIST}{_DRAWN}, {_ENERGY}, s AS (SELECT list_sort(list(value)) AS vs, avg(value) AS mean FROM v),
      e AS (SELECT mean, vs[CAST(floor((len(vs) - 1) * 0.025::DOUBLE) AS INT) + 1] AS lo, vs[CAST(ceil((len(vs) - 1) * 0.975::DOUBLE) AS INT) + 1] AS hi FROM s)
      SELECT 'energy' AS metric, round(mean, 9) AS mean, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round(hi - lo, 9) AS width FROM e""",
    "empirical_power_values": f"{_VALUES} SELECT * FROM long",
    "power_blocks": f"{_VALUES} SELECT * FROM long",
    "empirical_power": f"{_POWER} SELECT n, 'energy' AS metric, alpha, round(power, 9) AS power, round(threshold, 9) AS threshold, power >= 0.8 AS target_met FROM pow",
    "empirical_min_n": f"{_POWER} SELECT 'energy' AS metric, min(CASE WHEN alpha = 0.05::DOUBLE AND power >= 0.8 THEN n END) AS min_n FROM pow",
    "all_metrics": f"{_CTE} SELECT (SELECT mmd FROM ({CLOUDS['mmd']})) AS mmd, (SELECT js FROM ({CLOUDS['js_divergence']})) AS js, "
    + ", ".join(f"round({_CELL.format(q=a, p=b, c=b, k=k)}, 9) AS {name}_{k}" for k in (1, 3, 10) for name, a, b in (("precision", "q", "p"), ("recall", "p", "q"))),
}
