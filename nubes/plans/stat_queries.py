"""Queries of the statistics layer, over long tables made from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.plans.ordered import linear_quantiles
from nubes.functions import models, statistics as st


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6) -> F.Column:
    return F.round(c, digits)


def metric_values(spark, sf_dir) -> DataFrame:
    """(n, kind, metric, value): line items as repeats; odd orders are the effect, half as large again."""
    t = table(spark, sf_dir, "lineitem").where("l_returnflag IS NOT NULL AND l_orderkey IS NOT NULL")
    return t.select(
        ((F.col("l_linenumber") % 3 + 1) * 100).cast("int").alias("n"), F.when(F.col("l_orderkey") % 2 == 0, "control").otherwise("effect").alias("kind"),
        F.when(F.col("l_returnflag") == "A", "mmd").when(F.col("l_returnflag") == "N", "js").otherwise("precision@3").alias("metric"),
        (F.col("l_extendedprice") * (1 + 0.5 * (F.col("l_orderkey") % 2))).alias("value"), "l_orderkey", "l_linenumber",
    )


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: r(c) for c in names})


def power_table(spark, sf_dir):
    return _rounded(st.power_table(metric_values(spark, sf_dir), ["n"]), ["power", "threshold", "mean_control", "sd_control", "mean_effect", "z_mean_effect"])


def power_twosided(spark, sf_dir):
    out = st.power_table(metric_values(spark, sf_dir), ["n"], (0.1,), "twosided")
    return out.select("n", "metric", r("power").alias("power"), r("threshold").alias("threshold_lower"), r("threshold_upper").alias("threshold_upper"))


def least_n(spark, sf_dir):
    return st.least_n(st.power_table(metric_values(spark, sf_dir), ["n"]), target=0.8, alpha=0.20)


def contrast_table(spark, sf_dir):
    out = st.contrast_table(metric_values(spark, sf_dir), ["n"])
    return out.select("l_orderkey", "l_linenumber", "n", "metric", r("delta", 4).alias("delta"), r("z").alias("z"))


def benjamini_hochberg(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) / 10007.0).alias("p"))
    t = t.withColumn("p", F.col("p") * F.col("p") * F.col("p"))
    return st.benjamini_hochberg(t, ["o_orderpriority"], "p", ["o_orderkey"]).withColumns({"p": r("p", 9), "adjusted": r("adjusted", 9)})


def first_detected(spark, sf_dir):
    """The first month in which the 95 % interval of Student's law of a segment's price over the all-time mean lies above 0."""
    t = table(spark, sf_dir, "orders")
    mean = t.agg(F.avg("o_totalprice").alias("mu"))
    rows = t.crossJoin(F.broadcast(mean)).select("o_orderpriority", F.month("o_orderdate").alias("step"), (F.col("o_totalprice") - F.col("mu")).alias("delta"))
    by = rows.groupBy("o_orderpriority", "step").agg(F.avg("delta").alias("m"), (F.stddev_samp("delta") / F.sqrt(F.count("*"))).alias("se"), (F.count("*") - 1).cast("double").alias("df"))
    low = by.select("o_orderpriority", "step", (F.col("m") - st.t_quantile_column(F.lit(0.975), F.col("df")) * F.col("se")).alias("ci_low"))
    out = st.first_detected(rows.join(low, ["o_orderpriority", "step"]), ["o_orderpriority"])
    return out.select("o_orderpriority", "step", r("delta").alias("delta"), r("direction_share").alias("direction_share"))


def welch_table(spark, sf_dir):
    """Effects of every metric and size with Welch intervals."""
    out = st.welch_table(metric_values(spark, sf_dir), ["n"])
    return out.select("n", "metric", r("delta", 4).alias("delta"), r("se", 4).alias("se"), r("df", 4).alias("df"), r("ci_low", 3).alias("ci_low"), r("ci_high", 3).alias("ci_high"), r("p_value").alias("p_value"))


def trajectories(spark, sf_dir) -> DataFrame:
    """(experiment, step, a, b, c): monthly figures of each order priority."""
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("experiment"), F.month("o_orderdate").alias("step"))
    return t.agg(F.round(F.avg("o_totalprice"), 6).alias("a"), F.count("*").cast("double").alias("b"), (1 - F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))).alias("c"))


def trajectory_correlation(spark, sf_dir):
    """Spearman between each two metrics over the steps of an experiment; means over experiments."""
    t = trajectories(spark, sf_dir)
    parts = [st.spearman(t, ["experiment"], x, y).select("experiment", F.lit(x).alias("m1"), F.lit(y).alias("m2"), "rho") for x, y in (("a", "b"), ("a", "c"), ("b", "c"))]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return every.groupBy("m1", "m2").agg(r(F.avg("rho")).alias("rho"), F.count("rho").alias("n"))


def correlation_by_group(spark, sf_dir):
    """The mean correlation of quantity with price, discount with price, by flag and status, as a pivoted table."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return t.agg(r(F.corr("l_quantity", "l_extendedprice")).alias("rho")).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.first("rho"))


def moment_diagnostics(spark, sf_dir):
    """Largest differences of means and of population covariances of two clouds in the plane."""
    t = table(spark, sf_dir, "lineitem").where("l_linestatus IN ('F', 'O')").select("l_linestatus", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    m = t.groupBy("l_linestatus").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"))
    spread = lambda c: F.max(c) - F.min(c)
    return m.agg(r(F.greatest(spread("mx"), spread("my"))).alias("mean_gap"), r(F.greatest(spread("xx"), spread("xy"), spread("yy"))).alias("cov_gap"))


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality IS NOT NULL AND n_chars IS NOT NULL")


def detection_quality(spark, sf_dir):
    t = labelled(spark, sf_dir).select(F.coalesce("lang", F.lit("?")).alias("lang"), F.col("n_chars").cast("double").alias("score"), F.col("quality").cast("long").alias("label"))
    return _rounded(st.detection_quality(t, ["lang"], "score", "label", 1000.0), ["auroc", "auprc", "balanced_accuracy"])


def two_sample_ks(spark, sf_dir):
    return _rounded(st.two_sample_ks(labelled(spark, sf_dir), "quality", "n_chars"), ["ks_stat", "ks_p"])


def grouped_bootstrap(spark, sf_dir):
    """Percentile interval of the mean balance, nations drawn whole, 50 resamples."""
    c = table(spark, sf_dir, "customer").where("c_acctbal IS NOT NULL")
    per = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    means = st.bootstrap_draws(c, "c_nationkey", 50).join(per, "c_nationkey").groupBy("resample").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    return linear_quantiles(means, [], "m", {"low": 0.025, "median": 0.5, "high": 0.975}).select(*(r(c, 4).alias(c) for c in ("low", "median", "high")))


def paired_permutation(spark, sf_dir):
    """Sign flips of each nation's customer minus supplier mean balance: the p-value of their mean, never 0."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.avg("s_acctbal").alias("b"))
    pairs = c.join(s, "c_nationkey").select("c_nationkey", (F.col("a") - F.col("b")).alias("d"))
    null = st.pair_signs(pairs, "c_nationkey", 99).join(pairs, "c_nationkey").groupBy("permutation").agg(F.abs(F.avg(F.col("sign") * F.col("d"))).alias("t"))
    seen = pairs.agg(F.abs(F.avg("d")).alias("observed"))
    rows = null.crossJoin(F.broadcast(seen))
    return rows.groupBy(r("observed").alias("observed")).agg(r(st.upper_tail_p(F.col("observed"), F.col("t"))).alias("p"))


def score_statistics(spark, sf_dir):
    """Items as orders, tokens as their line items with probability quantity / 51: nll, perplexity, mean entropy term, length."""
    t = table(spark, sf_dir, "lineitem").where("l_quantity > 0").withColumn("lp", F.log(F.col("l_quantity") / 51.0))
    out = t.groupBy("l_orderkey").agg((-F.avg("lp")).alias("nll"), (-F.sum(F.exp("lp") * F.col("lp"))).alias("entropy"), F.count("*").alias("length"))
    return out.select("l_orderkey", r("nll").alias("nll"), r(F.exp("nll")).alias("ppl"), r("entropy").alias("entropy"), "length")


def packet_features(spark, sf_dir):
    """Mean and population deviation over a packet's items, NaN and null left out."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return t.groupBy("o_custkey").agg(
        F.count("*").alias("n"), r(F.avg(known("l_discount"))).alias("discount_mean"), r(F.stddev_pop(known("l_discount"))).alias("discount_sd"),
        r(F.avg(known("l_tax"))).alias("tax_mean"), r(F.stddev_pop(known("l_tax"))).alias("tax_sd"),
    )


def describe_lengths(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL")
    q = linear_quantiles(t.select("lang", F.col("n_chars").cast("double").alias("n_chars")), ["lang"], "n_chars", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = t.groupBy(F.col("lang").alias("l_")).agg(F.count("*").alias("count"), r(F.avg("n_chars")).alias("mean"), r(F.stddev_samp("n_chars")).alias("std"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"))
    return out.join(q, F.col("l_").eqNullSafe(F.col("lang"))).select("lang", "count", "mean", "std", "min", "max", *(r(c).alias(c) for c in ("q25", "median", "q75")))


def closest_level(spark, sf_dir):
    """Per brand the size whose mean price comes closest to 1400; ties to the smaller size."""
    t = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m"))
    best = t.groupBy("p_brand").agg(F.min(F.struct(r(F.abs(F.col("m") - 1400.0), 6).alias("gap"), "p_size")).alias("b"))
    return best.select("p_brand", "b.p_size", "b.gap")


def threshold_calibration(spark, sf_dir):
    """The 0.95 quantile of |z| of even orders' lines, and the share of odd orders' lines beyond it, by flag."""
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 2).alias("half"), F.col("l_discount").alias("v"))
    base = t.where("half = 0").groupBy("l_returnflag").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))
    z = t.join(base.where("n >= 50"), "l_returnflag").select("l_returnflag", "half", r(F.abs(F.col("v") - F.col("mu")) / F.col("sd"), 9).alias("z"))
    crit = linear_quantiles(z.where("half = 0").select("l_returnflag", "z"), ["l_returnflag"], "z", {"z_crit": 0.95})
    return z.where("half = 1").join(crit, "l_returnflag").groupBy("l_returnflag").agg(r(F.first("z_crit")).alias("z_crit"), r(F.avg((F.col("z") > F.col("z_crit")).cast("int"))).alias("fpr"), F.count("*").alias("n"))


def calibration_intervals(spark, sf_dir):
    """Clopper-Pearson intervals of the share of late-shipped lines by flag."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_tax") > 0.06).alias("hits"), F.count("*").alias("n"))

    def intervals(frames):
        for f in frames:
            both = [st.binomial_interval(int(h), int(n)) for h, n in zip(f.hits, f.n)]
            yield f.assign(low=[round(b[0], 9) for b in both], high=[round(b[1], 9) for b in both])

    return t.mapInPandas(intervals, "l_returnflag string, hits long, n long, low double, high double")


def effect_table(spark, sf_dir):
    out = models.effect_table(metric_values(spark, sf_dir), ["n"])
    return _rounded(out, ["delta", "z_mean", "p_value"])


def evaluate_detection(spark, sf_dir):
    """Five group folds over documents: logistic regression of quality on length figures, scored out of fold."""
    return _rounded(models.evaluate_detection(models.text_features(labelled(spark, sf_dir)), "quality"), ["auroc", "auprc", "balanced_accuracy"])


def evaluate_regression(spark, sf_dir):
    return _rounded(models.evaluate_regression(models.text_features(labelled(spark, sf_dir)), "quality"), ["mae", "r2", "rho"])


_VALUES = """v AS (SELECT (l_linenumber % 3 + 1) * 100 AS n, CASE WHEN l_orderkey % 2 = 0 THEN 'control' ELSE 'effect' END AS kind,
  CASE l_returnflag WHEN 'A' THEN 'mmd' WHEN 'N' THEN 'js' ELSE 'precision@3' END AS metric, l_extendedprice * (1 + 0.5::DOUBLE * (l_orderkey % 2)) AS value, l_orderkey, l_linenumber
  FROM lineitem WHERE l_returnflag IS NOT NULL AND l_orderkey IS NOT NULL),
c AS (SELECT n, metric, count(*) AS n_control, avg(value) AS mean_control, stddev_samp(value) AS sd_control, list(value ORDER BY value) AS s FROM v WHERE kind = 'control' GROUP BY 1, 2)"""


#: P(T > t) by Simpson's rule over 2,000 steps from 0 to t.
_TAIL = """SELECT {keys}, 0.5::DOUBLE - sign(max({t})) * sum(exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5::DOUBLE * ln(df * pi()) - (df + 1) / 2 * ln(1 + (abs({t}) * i / 2000) ** 2 / df))
    * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * max(abs({t})) / 6000 AS tail FROM {rows}, range(2001) s(i) WHERE {t} IS NOT NULL GROUP BY ALL"""


def _power(alphas: tuple) -> str:
    grid = ", ".join(f"({a!r}::DOUBLE, {1.0 - a!r}::DOUBLE)" for a in alphas)
    return f"""WITH {_VALUES}, a(alpha, up) AS (VALUES {grid}),
t AS (SELECT c.* EXCLUDE (s), alpha, metric LIKE 'precision%' AS less, CASE WHEN metric LIKE 'precision%' THEN s[CAST(floor((n_control - 1) * alpha) AS INT) + 1] ELSE s[CAST(ceil((n_control - 1) * up) AS INT) + 1] END AS threshold FROM c, a),
p AS (SELECT v.n, v.metric, alpha, avg(CASE WHEN CASE WHEN less THEN value < threshold ELSE value > threshold END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS power, any_value(threshold) AS threshold, any_value(n_control) AS n_control,
  count(*) AS n_effect, any_value(mean_control) AS mean_control, any_value(sd_control) AS sd_control, avg(value) AS mean_effect, avg((value - mean_control) / sd_control) AS z_mean_effect
  FROM v JOIN t ON v.n = t.n AND v.metric = t.metric WHERE kind = 'effect' GROUP BY 1, 2, 3)"""


_BH = """WITH o AS (SELECT o_orderkey, o_orderpriority, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS x FROM orders), q AS (SELECT o_orderkey, o_orderpriority, x * x * x AS p FROM o),
k AS (SELECT *, p * count(*) OVER (PARTITION BY o_orderpriority) / row_number() OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey) AS s FROM q),
m AS (SELECT *, least(1.0::DOUBLE, min(s) OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS a FROM k)
SELECT o_orderkey, o_orderpriority, round(p, 9) AS p, round(a, 9) AS adjusted, a <= 0.05 AS reject FROM m"""
_RANK = "(rank() OVER (PARTITION BY experiment ORDER BY {0}) + (count(*) OVER (PARTITION BY experiment, {0}) - 1) / 2.0::DOUBLE)"
_CODE = "CAST('0x' || substr(md5(concat_ws('|', '0', {0}, {1})), 1, {2}) AS BIGINT)"

ORACLES = {
    "power_table": _power(st.ALPHAS) + """ SELECT n, metric, alpha, round(power, 6) AS power, round(threshold, 6) AS threshold, n_control, n_effect, round(mean_control, 6) AS mean_control, round(sd_control, 6) AS sd_control,
        round(mean_effect, 6) AS mean_effect, round(z_mean_effect, 6) AS z_mean_effect, power >= 0.8 AS target_met FROM p""",
    "power_twosided": f"""WITH {_VALUES}, t AS (SELECT n, metric, s[CAST(ceil((n_control - 1) * 0.05::DOUBLE) AS INT) + 1] AS lo, s[CAST(ceil((n_control - 1) * 0.95::DOUBLE) AS INT) + 1] AS hi FROM c)
        SELECT v.n, v.metric, round(avg(CASE WHEN value < lo OR value > hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS power, round(any_value(lo), 6) AS threshold_lower, round(any_value(hi), 6) AS threshold_upper
        FROM v JOIN t ON v.n = t.n AND v.metric = t.metric WHERE kind = 'effect' GROUP BY 1, 2""",
    "least_n": _power(st.ALPHAS) + " SELECT metric, min(CASE WHEN alpha = 0.2::DOUBLE AND power >= 0.8::DOUBLE THEN n END) AS min_n FROM p GROUP BY 1",
    "contrast_table": f"""WITH {_VALUES}, d AS (SELECT l_orderkey, l_linenumber, v.n, v.metric, CASE WHEN v.metric LIKE 'precision%' THEN -1 ELSE 1 END * (value - mean_control) AS delta, sd_control
        FROM v LEFT JOIN c ON v.n = c.n AND v.metric = c.metric WHERE kind = 'effect') SELECT l_orderkey, l_linenumber, n, metric, round(delta, 4) AS delta, round(delta / (sd_control + 1e-12::DOUBLE), 6) AS z FROM d""",
    "benjamini_hochberg": _BH,
    # the interval lies above 0 where the upper tail beyond mean / se is under 0.025
    "first_detected": f"""WITH m AS (SELECT avg(o_totalprice) AS mu FROM orders), d AS (SELECT o_orderpriority, month(o_orderdate) AS step, o_totalprice - mu AS delta FROM orders, m),
        g AS (SELECT o_orderpriority, step, avg(delta) AS delta, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) AS t, (count(*) - 1)::DOUBLE AS df, avg(CASE WHEN delta > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM d GROUP BY 1, 2),
        p AS ({_TAIL.format(rows='g', t='t', keys='o_orderpriority, step')}), h AS (SELECT g.*, tail < 0.025 AS found FROM g LEFT JOIN p USING (o_orderpriority, step))
        SELECT o_orderpriority, CAST(min(step) FILTER (found) AS INT) AS step, round(arg_min(delta, step) FILTER (found), 6) AS delta, round(arg_min(share, step) FILTER (found), 6) AS direction_share FROM h GROUP BY 1""",
    # the quantile by its expansion in 1 / df, exact to 1e-9 at the hundreds of degrees of freedom here
    "welch_table": f"""WITH {_VALUES}, g AS (SELECT n, metric, avg(value) FILTER (kind = 'control') AS m0, var_samp(value) FILTER (kind = 'control') / count(*) FILTER (kind = 'control') AS a, count(*) FILTER (kind = 'control') AS n0,
          avg(value) FILTER (kind = 'effect') AS m1, var_samp(value) FILTER (kind = 'effect') / count(*) FILTER (kind = 'effect') AS b, count(*) FILTER (kind = 'effect') AS n1 FROM v GROUP BY 1, 2),
        e AS (SELECT n, metric, CASE WHEN metric LIKE 'precision%' THEN -1 ELSE 1 END * (m1 - m0) AS delta, sqrt(a + b) AS se, (a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1)) AS df FROM g),
        k AS (SELECT n, metric, df, 1.9599639845400545::DOUBLE AS z FROM e),
        q AS (SELECT n, metric, z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
          + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * df**4) AS q FROM k),
        f AS (SELECT n, metric, df, abs(delta / se) AS t FROM e), p AS ({_TAIL.format(rows='f', t='t', keys='n, metric')})
        SELECT n, metric, round(delta, 4) AS delta, round(se, 4) AS se, round(df, 4) AS df, round(delta - q * se, 3) AS ci_low, round(delta + q * se, 3) AS ci_high, round(least(1.0::DOUBLE, 2 * tail), 6) AS p_value
        FROM e JOIN q USING (n, metric) JOIN p USING (n, metric)""",
    "trajectory_correlation": f"""WITH t AS (SELECT o_orderpriority AS experiment, month(o_orderdate) AS step, round(avg(o_totalprice), 6) AS a, count(*)::DOUBLE AS b, 1 - avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS c FROM orders GROUP BY 1, 2),
        k AS (SELECT experiment, {_RANK.format('a')} AS ra, {_RANK.format('b')} AS rb, {_RANK.format('c')} AS rc FROM t),
        e AS (SELECT experiment, corr(ra, rb) AS ab, corr(ra, rc) AS ac, corr(rb, rc) AS bc FROM k GROUP BY 1)
        SELECT 'a' AS m1, 'b' AS m2, round(avg(ab), 6) AS rho, count(ab) AS n FROM e UNION ALL SELECT 'a', 'c', round(avg(ac), 6), count(ac) FROM e UNION ALL SELECT 'b', 'c', round(avg(bc), 6), count(bc) FROM e""",
    "correlation_by_group": """WITH g AS (SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS rho FROM lineitem GROUP BY 1, 2)
        SELECT l_returnflag, max(rho) FILTER (l_linestatus = 'F') AS F, max(rho) FILTER (l_linestatus = 'O') AS O FROM g GROUP BY 1""",
    "moment_diagnostics": """WITH t AS (SELECT l_linestatus, l_quantity AS x, l_discount * 100 AS y FROM lineitem WHERE l_linestatus IN ('F', 'O')),
        m AS (SELECT l_linestatus, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy FROM t GROUP BY 1)
        SELECT round(greatest(max(mx) - min(mx), max(my) - min(my)), 6) AS mean_gap, round(greatest(max(xx) - min(xx), max(xy) - min(xy), max(yy) - min(yy)), 6) AS cov_gap FROM m""",
    "detection_quality": """WITH t AS (SELECT coalesce(lang, '?') AS lang, n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
        k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS rk FROM t),
        u AS (SELECT lang, (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS auroc,
              (avg(CASE WHEN score >= 1000 THEN 1.0::DOUBLE ELSE 0 END) FILTER (label = 1) + avg(CASE WHEN score < 1000 THEN 1.0::DOUBLE ELSE 0 END) FILTER (label = 0)) / 2 AS ba, sum(label) AS p, sum(1 - label) AS n FROM k GROUP BY 1),
        s AS (SELECT lang, score, sum(label) AS pos, count(*) AS c FROM t GROUP BY 1, 2),
        w AS (SELECT lang, pos, sum(pos) OVER q AS tp, sum(c) OVER q AS upto FROM s WINDOW q AS (PARTITION BY lang ORDER BY score DESC)),
        z AS (SELECT lang, sum(pos / p::DOUBLE * tp / upto) AS ap FROM w JOIN u USING (lang) GROUP BY 1)
        SELECT lang, CASE WHEN p > 0 AND n > 0 THEN round(auroc, 6) END AS auroc, CASE WHEN p > 0 AND n > 0 THEN round(ap, 6) END AS auprc, CASE WHEN p > 0 AND n > 0 THEN round(ba, 6) END AS balanced_accuracy FROM u JOIN z USING (lang)""",
    # twice the normal tail by Simpson's rule up to 8.5 deviations
    "effect_table": f"""WITH {_VALUES}, g AS (SELECT n, metric, avg(value) FILTER (kind = 'control') AS m0, stddev_samp(value) FILTER (kind = 'control') AS s0, avg(value) FILTER (kind = 'effect') AS m1, count(*) FILTER (kind = 'effect') AS n1 FROM v GROUP BY 1, 2),
        e AS (SELECT n, metric, CASE WHEN metric LIKE 'precision%' THEN -1 ELSE 1 END * (m1 - m0) AS delta, CASE WHEN s0 > 0 THEN CASE WHEN metric LIKE 'precision%' THEN -1 ELSE 1 END * (m1 - m0) / (s0 / sqrt(n1)) END AS z FROM g),
        p AS (SELECT n, metric, greatest(0.0::DOUBLE, 1 - 2 * sum(exp(-0.5::DOUBLE * (least(abs(z), 8.5) * i / 2000) ** 2) / sqrt(2 * pi()) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * max(least(abs(z), 8.5)) / 6000) AS p
          FROM e, range(2001) s(i) GROUP BY 1, 2)
        SELECT n, metric, round(delta, 6) AS delta, round(z, 6) AS z_mean, round(p, 6) AS p_value FROM e JOIN p USING (n, metric)""",
    "two_sample_ks": f"""WITH t AS (SELECT quality, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
        c AS (SELECT n_chars, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS b FROM t GROUP BY 1),
        u AS (SELECT sum(a) OVER (ORDER BY n_chars) AS fa, sum(b) OVER (ORDER BY n_chars) AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c),
        g AS (SELECT max(abs(fa / na - fb / nb)) AS d, max(na)::DOUBLE AS na, max(nb)::DOUBLE AS nb FROM u), l AS (SELECT d, d * sqrt(na * nb / (na + nb)) AS lam FROM g)
        SELECT round(d, 6) AS ks_stat, round(CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (SELECT sum((-1) ** (j - 1) * exp(-2.0::DOUBLE * j * j * lam * lam)) FROM range(1, 101) s(j)))) END, 6) AS ks_p FROM l""",
    "grouped_bootstrap": f"""WITH c AS (SELECT c_nationkey, sum(c_acctbal) AS s, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY 1),
        i AS (SELECT *, row_number() OVER (ORDER BY c_nationkey) AS place FROM c),
        d AS (SELECT r AS resample, {_CODE.format('r', 'place', 12)} % (SELECT count(*) FROM c) + 1 AS place FROM i, range(50) t(r)),
        m AS (SELECT resample, sum(s) / sum(n) AS m FROM d JOIN i USING (place) GROUP BY 1)
        SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.5), 4) AS median, round(quantile_cont(m, 0.975), 4) AS high FROM m""",
    "paired_permutation": f"""WITH d AS (SELECT c_nationkey, a - b AS d FROM (SELECT c_nationkey, avg(c_acctbal) AS a FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, avg(s_acctbal) AS b FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey),
        o AS (SELECT abs(avg(d)) AS observed FROM d), n AS (SELECT r, abs(avg((1 - 2 * ({_CODE.format('r', 'c_nationkey', 1)} % 2)) * d)) AS t FROM d, range(99) t(r) GROUP BY 1)
        SELECT round(any_value(observed), 6) AS observed, round((count(*) FILTER (t >= observed) + 1)::DOUBLE / (count(*) + 1), 6) AS p FROM n, o""",
    "score_statistics": """WITH t AS (SELECT l_orderkey, ln(l_quantity / 51.0::DOUBLE) AS lp FROM lineitem WHERE l_quantity > 0), g AS (SELECT l_orderkey, -avg(lp) AS nll, -sum(exp(lp) * lp) AS entropy, count(*) AS length FROM t GROUP BY 1)
        SELECT l_orderkey, round(nll, 6) AS nll, round(exp(nll), 6) AS ppl, round(entropy, 6) AS entropy, length FROM g""",
    "packet_features": """SELECT o_custkey, count(*) AS n, round(avg(l_discount), 6) AS discount_mean, round(stddev_pop(l_discount), 6) AS discount_sd, round(avg(l_tax), 6) AS tax_mean, round(stddev_pop(l_tax), 6) AS tax_sd
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "describe_lengths": """SELECT lang, count(*) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, max(n_chars) AS max, round(quantile_cont(n_chars, 0.25), 6) AS q25,
        round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q75 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""",
    "closest_level": """WITH g AS (SELECT p_brand, p_size, round(abs(avg(p_retailprice) - 1400), 6) AS gap FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY gap, p_size) AS k FROM g)
        SELECT p_brand, p_size, gap FROM k WHERE k = 1""",
    "threshold_calibration": """WITH t AS (SELECT l_returnflag, l_orderkey % 2 AS half, l_discount AS v FROM lineitem), b AS (SELECT l_returnflag, avg(v) AS mu, stddev_samp(v) AS sd FROM t WHERE half = 0 GROUP BY 1 HAVING count(*) >= 50),
        z AS (SELECT l_returnflag, half, round(abs(v - mu) / sd, 9) AS z FROM t JOIN b USING (l_returnflag)), c AS (SELECT l_returnflag, quantile_cont(z, 0.95) AS z_crit FROM z WHERE half = 0 GROUP BY 1)
        SELECT l_returnflag, round(any_value(z_crit), 6) AS z_crit, round(avg(CASE WHEN z > z_crit THEN 1.0::DOUBLE ELSE 0 END), 6) AS fpr, count(*) AS n FROM z JOIN c USING (l_returnflag) WHERE half = 1 GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        power_table, power_twosided, least_n, contrast_table, benjamini_hochberg, first_detected, welch_table, trajectory_correlation, correlation_by_group, moment_diagnostics, detection_quality, two_sample_ks,
        grouped_bootstrap, paired_permutation, score_statistics, packet_features, describe_lengths, closest_level, threshold_calibration, calibration_intervals, effect_table, evaluate_detection, evaluate_regression,
    )
}
