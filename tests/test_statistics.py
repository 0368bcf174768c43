import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.functions import statistics as st
from nubes.plans.ordered import average_ranks, order_statistics, ranked


def test_benjamini_hochberg_by_hand(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "family string, i int, p double")
    rows = st.benjamini_hochberg(df, ["family"], "p", ["i"]).orderBy("i").collect()
    assert [round(r.adjusted, 4) for r in rows] == [0.008, 0.032, 0.0672, 0.0672, 0.0672, 0.08, 0.0846, 0.205]
    assert [r.reject for r in rows] == [True, True] + [False] * 6
    with pytest.raises(Exception, match="p-values"):
        st.benjamini_hochberg(df.withColumn("p", F.lit(1.5)), ["family"], "p", ["i"]).collect()


@pytest.mark.parametrize("n", [11, 20, 21, 30])
def test_order_statistics_follow_numpy(spark, n):
    v = np.random.default_rng(n).normal(size=n).round(1)
    df = spark.createDataFrame([("k", float(x)) for x in v] + [("k", None), ("k", float("nan"))], "k string, v double")
    got = order_statistics(df, ["k"], "v", {"up": (0.95, "higher"), "down": (0.05, "lower")}).first()
    assert (got.up, got.down) == (np.quantile(v, 0.95, method="higher"), np.quantile(v, 0.05, method="lower"))


def test_power_counts_nan_as_missed_and_flips_for_similarity(spark):
    rows = [(1, "control", m, float(i)) for m in ("mmd", "precision@1") for i in range(20)]
    rows += [(1, "effect", "mmd", v) for v in (100.0, float("nan"), 5.0, float("inf"))] + [(1, "effect", "precision@1", -1.0)]
    out = {r.metric: r for r in st.power_table(spark.createDataFrame(rows, "n int, kind string, metric string, value double"), ["n"], (0.05,)).collect()}
    assert out["mmd"].power == 0.5 and out["mmd"].threshold == 19.0
    assert out["precision@1"].power == 1.0 and out["precision@1"].target_met
    assert {r.metric: r.min_n for r in st.least_n(st.power_table(spark.createDataFrame(rows, "n int, kind string, metric string, value double"), ["n"])).collect()} == {"mmd": None, "precision@1": 1}


def test_contrast_needs_two_finite_controls(spark):
    rows = [("control", "mmd", 1.0), ("control", "mmd", 3.0), ("control", "js", 1.0), ("control", "js", float("inf")), ("effect", "mmd", 4.0), ("effect", "js", 2.0), ("effect", "mmd", float("nan"))]
    out = st.contrast_table(spark.createDataFrame(rows, "kind string, metric string, value double"), []).orderBy("metric", "value").collect()
    assert out[0].delta is None and out[1].delta == 2.0 and out[1].z == pytest.approx(math.sqrt(2)) and math.isnan(out[2].delta)


def test_ranks_span_partitions_and_ties_share(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), "id", (F.col("id") % 7).alias("v"))
    assert [r.rank for r in ranked(df, ["k"], ["v", "id"]).orderBy("v", "id").collect()] == list(range(1, 1001))
    some = average_ranks(df.where("id < 14"), ["k"], "v").select("v", "rank").distinct().orderBy("v").collect()
    assert [r.rank for r in some] == [1.5 + 2 * i for i in range(7)]
    assert ranked(df.where("id < 0"), ["k"], ["id"]).count() == 0


def test_detection_quality_of_perfect_and_constant_scores(spark):
    rows = [("good", float(i), int(i >= 5)) for i in range(10)] + [("flat", 1.0, i % 2) for i in range(10)] + [("one", 1.0, 1)]
    out = {r.k: r for r in st.detection_quality(spark.createDataFrame(rows, "k string, s double, y long"), ["k"], "s", "y", 5.0).collect()}
    assert (out["good"].auroc, out["good"].auprc, out["good"].balanced_accuracy) == (1.0, 1.0, 1.0)
    assert (out["flat"].auroc, out["flat"].auprc) == (0.5, 0.5) and out["one"].auroc is None


def test_intervals_and_first_detection(spark):
    assert st.binomial_interval(0, 10) == pytest.approx((0.0, 0.308497), abs=1e-5)
    assert st.binomial_interval(5, 10) == pytest.approx((0.187086, 0.812914), abs=1e-5)
    rows = [("a", 1, 0.5, -0.1), ("a", 2, 1.0, 0.2), ("a", 2, -1.0, 0.2), ("a", 3, 9.0, 1.0), ("b", 1, 1.0, float("nan"))]
    out = {r.k: r for r in st.first_detected(spark.createDataFrame(rows, "k string, step int, delta double, ci_low double"), ["k"]).collect()}
    assert (out["a"].step, out["a"].delta, out["a"].direction_share) == (2, 0.0, 0.5) and out["b"].step is None


def test_bootstrap_draws_as_many_groups_as_there_are(spark):
    draws = st.bootstrap_draws(spark.range(9).withColumnRenamed("id", "g"), "g", 6)
    assert {r["sum(times)"] for r in draws.groupBy("resample").sum("times").collect()} == {9}
