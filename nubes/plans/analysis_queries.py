"""Analyses on top of the metrics: bars in SQL, memberships by k, strong levels, joint intervals, heat maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from nubes.functions import statistics as st
from nubes.operators import clouds, topology
from nubes.operators.trials import intervals
from nubes.plans.cloud_queries import _CTE, _RADII, pair, r9
from nubes.plans.stat_queries import _CODE, _VALUES, metric_values, table, trajectories

KS = (1, 3, 10)
RESAMPLES = 40


def bar_statistics(spark, sf_dir):
    """Lengths of the merges of P and of Q: mean, deviation and quartiles."""
    p, q = pair(spark, sf_dir)
    bars = [topology.h0_bars(c).withColumn("cloud", F.lit(name)) for name, c in (("p", p), ("q", q))]
    out = topology.bar_statistics(bars[0].unionAll(bars[1]), ["cloud"])
    return out.select("cloud", "n", *(r9(c).alias(c) for c in ("mean", "sd", "q25", "median", "q75", "longest")))


def frechet_plane(spark, sf_dir):
    """The Fréchet distance of the first two components."""
    flat = [c.select("pid", F.slice("x", 1, 2).alias("x")) for c in pair(spark, sf_dir)]
    return spark.createDataFrame([(round(topology.frechet(*map(clouds.moments, flat)), 8),)], "frechet double")


def membership(spark, sf_dir):
    """A row for every point of P as a center with its radius, and for every point of Q with whether a ball covers it, for each k."""
    p, q = pair(spark, sf_dir)
    near = clouds.nearest_distances(p, max(KS))
    centers = p.join(near, "pid").select("pid", "x", *(F.element_at("near", k).alias(f"r{k}") for k in KS))
    covered = clouds.coverage(centers, q, [f"r{k}" for k in KS])
    none = F.lit(None)
    rows = [centers.select(F.lit("center").alias("role"), "pid", F.lit(k).alias("k"), r9(f"r{k}").alias("radius"), none.cast("boolean").alias("covered")) for k in KS]
    rows += [covered.select(F.lit("query").alias("role"), "pid", F.lit(k).alias("k"), none.cast("double").alias("radius"), F.col(f"r{k}").alias("covered")) for k in KS]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def strong_levels(spark, sf_dir):
    """The first size at which a metric's mean effect lies three standard errors off, and how far it gets."""
    from nubes.functions import models

    out = st.strong_level(models.effect_table(metric_values(spark, sf_dir), ["n"]), ["metric"], "n", "z_mean")
    return out.select("metric", "first_level", F.round("max_z", 6).alias("max_z"))


def repeat_intervals(spark, sf_dir):
    """Intervals of the monthly figures of every priority, months drawn anew together for all figures."""
    t = trajectories(spark, sf_dir)
    long = t.select(F.col("step").alias("repeat"), F.explode(F.array(*(F.struct(F.concat_ws("/", "experiment", F.lit(c)).alias("metric"), F.col(c).alias("value")) for c in ("a", "c")))).alias("v")).select("repeat", "v.*")
    out = intervals(st.joint_means(long, "repeat", RESAMPLES), ["metric"])
    return out.select("metric", *(F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high", "width")))


def mean_heatmap(spark, sf_dir):
    """Mean prices by flag and line number, one column for each flag."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_extendedprice"))
    return t.select("l_linenumber", *(F.round(c, 4).alias(c) for c in ("A", "N", "R")))


QUERIES = {f.__name__: f for f in (bar_statistics, frechet_plane, membership, strong_levels, repeat_intervals, mean_heatmap)}


def _tree(c: str) -> str:
    """Prim's rounds over the points of ``c``, the length of each round's edge in w."""
    return f"""d{c} AS MATERIALIZED (SELECT a.pid AS i, b.pid AS j, list_distance(a.x, b.x) AS d FROM {c} a, {c} b WHERE a.pid <> b.pid),
      t{c}(step, visited, w) AS (SELECT 0, [min(pid)], NULL::DOUBLE FROM {c} UNION ALL
        SELECT step + 1, list_append(any_value(visited), arg_min(j, d)), min(d) FROM t{c} JOIN d{c} ON list_contains(visited, i) AND NOT list_contains(visited, j) GROUP BY step)"""


_BARS = _CTE.replace("WITH", "WITH RECURSIVE", 1) + ", " + _tree("p") + ", b AS (SELECT w FROM tp WHERE w IS NOT NULL)"
_STATS = "count(*) AS n, round(avg(w), 9) AS mean, round(stddev_samp(w), 9) AS sd, " + ", ".join(f"round(quantile_cont(w, {q}), 9) AS {n}" for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))) + ", round(max(w), 9) AS longest"


def _moments(c: str) -> str:
    """Means and ridged covariances of the plane."""
    ridge = "(1e-8::DOUBLE * (u + w) / 2 + 1e-12::DOUBLE)"
    return f"SELECT ma, mb, u + {ridge} AS u, v, w + {ridge} AS w FROM (SELECT avg(x[1]) AS ma, avg(x[2]) AS mb, var_samp(x[1]) AS u, covar_samp(x[1], x[2]) AS v, var_samp(x[2]) AS w FROM {c})"


ORACLES = {
    "h0_barcode": f"{_BARS} SELECT 0.0::DOUBLE AS birth, round(w, 9) AS death FROM b UNION ALL SELECT 0.0::DOUBLE, 'inf'::DOUBLE",
    "bar_summary": f"""{_BARS} SELECT 'p' AS cloud, count(*) + 1 AS n, count(*) AS n_finite, round(sum(w), 9) AS total, round(max(w), 9) AS longest, round(avg(w), 9) AS mean, round(max(w), 9) AS max_death,
        count(*) FILTER (w > 1) AS n_above FROM b""",
    "top_bars": f"{_BARS} SELECT 0.0::DOUBLE AS birth, round(w, 9) AS death FROM b ORDER BY w DESC LIMIT 5",
    "bar_statistics": f"{_CTE.replace('WITH', 'WITH RECURSIVE', 1)}, {_tree('p')}, {_tree('q')} SELECT 'p' AS cloud, {_STATS} FROM tp WHERE w IS NOT NULL UNION ALL SELECT 'q', {_STATS} FROM tq WHERE w IS NOT NULL",
    # Q as one point, number -1, as far from a point of P as the nearest of Q
    "mtd0": f"""{_CTE.replace('WITH', 'WITH RECURSIVE', 1)}, n AS (SELECT p.pid, min(list_distance(p.x, q.x)) AS d FROM p, q GROUP BY 1),
        e AS MATERIALIZED (SELECT a.pid AS i, b.pid AS j, list_distance(a.x, b.x) AS d FROM p a, p b WHERE a.pid <> b.pid UNION ALL SELECT -1, pid, d FROM n UNION ALL SELECT pid, -1, d FROM n),
        t(step, visited, w) AS (SELECT 0, [-1::BIGINT], NULL::DOUBLE UNION ALL
          SELECT step + 1, list_append(any_value(visited), arg_min(j, d)), min(d) FROM t JOIN e ON list_contains(visited, i) AND NOT list_contains(visited, j) GROUP BY step)
        SELECT round(sum(w) / (SELECT count(*) FROM p), 9) AS mtd0 FROM t""",
    # of 2 x 2 matrices: tr sqrt(M) = sqrt(tr M + 2 sqrt(det M))
    "frechet_plane": f"""{_CTE}, a AS ({_moments('p')}), b AS ({_moments('q')})
        SELECT round(sqrt(greatest((a.ma - b.ma) ** 2 + (a.mb - b.mb) ** 2 + a.u + a.w + b.u + b.w
          - 2 * sqrt(a.u * b.u + 2 * a.v * b.v + a.w * b.w + 2 * sqrt((a.u * a.w - a.v * a.v) * (b.u * b.w - b.v * b.v))), 0.0::DOUBLE)), 8) AS frechet FROM a, b""",
    "membership": f"{_CTE} " + " UNION ALL ".join(
        f"""SELECT 'center' AS role, pid, {k} AS k, round(radius, 9) AS radius, NULL::BOOLEAN AS covered FROM ({_RADII.format(c='p', k=k)}) UNION ALL
        SELECT 'query', q.pid, {k}, NULL, bool_or(list_distance(q.x, p.x) <= r.radius + 1e-12::DOUBLE) FROM q, p JOIN ({_RADII.format(c='p', k=k)}) r ON r.pid = p.pid GROUP BY q.pid""" for k in KS
    ),
    "strong_levels": f"""WITH {_VALUES}, g AS (SELECT n, metric, abs(avg(value) FILTER (kind = 'effect') - avg(value) FILTER (kind = 'control')) / (stddev_samp(value) FILTER (kind = 'control') / sqrt(count(*) FILTER (kind = 'effect'))) AS z FROM v GROUP BY 1, 2)
        SELECT metric, min(CASE WHEN z >= 3 THEN n END) AS first_level, round(max(z), 6) AS max_z FROM g GROUP BY 1""",
    "repeat_intervals": f"""WITH t AS (SELECT o_orderpriority AS e, month(o_orderdate) AS repeat, round(avg(o_totalprice), 6) AS a, 1 - avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS c FROM orders GROUP BY 1, 2),
        l AS (SELECT repeat, concat_ws('/', e, 'a') AS metric, a AS value FROM t UNION ALL SELECT repeat, concat_ws('/', e, 'c'), c FROM t),
        i AS (SELECT repeat, row_number() OVER (ORDER BY repeat) AS place FROM (SELECT DISTINCT repeat FROM t WHERE repeat IS NOT NULL)),
        d AS (SELECT r AS resample, {_CODE.format('r', 'place', 12)} % (SELECT count(*) FROM i) + 1 AS place FROM i, range({RESAMPLES}) t(r)),
        m AS (SELECT resample, metric, avg(value) AS value FROM d JOIN i USING (place) JOIN l USING (repeat) GROUP BY 1, 2),
        v AS (SELECT metric, avg(value) AS mean, list_sort(list(value)) AS vs FROM m GROUP BY 1),
        e AS (SELECT metric, mean, vs[CAST(floor((len(vs) - 1) * 0.025::DOUBLE) AS INT) + 1] AS lo, vs[CAST(ceil((len(vs) - 1) * 0.975::DOUBLE) AS INT) + 1] AS hi FROM v)
        SELECT metric, round(mean, 6) AS mean, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(hi - lo, 6) AS width FROM e""",
    "mean_heatmap": "SELECT l_linenumber, " + ", ".join(f"round(avg(l_extendedprice) FILTER (l_returnflag = '{c}'), 4) AS {c}" for c in "ANR") + " FROM lineitem GROUP BY 1",
}
