"""Grouped moments and projections, group folds, ridge regressions and Student's law against numpy and tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.functions import folds, statistics
from nubes.operators import pools, transforms


def points(spark, x, groups):
    return spark.createDataFrame([(g, i, v.tolist()) for i, (g, v) in enumerate(zip(groups, x))], "space string, pid long, x array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)) * [3, 2, 1, 0.5] + 100
    return x, np.array(list("abc"))[rng.integers(0, 3, 120)]


def test_moments_of_many_groups(spark, data, monkeypatch):
    x, groups = data
    got = {r.space: r for r in pools.grouped_moments(points(spark, x, groups).repartition(5), ["space"]).collect()}
    assert set(got) == set("abc")
    for g, r in got.items():
        own = x[groups == g]
        assert r.n == len(own) and np.allclose(r["mean"], own.mean(0)) and np.allclose(np.array(r.m2).reshape(4, 4) / (r.n - 1), np.cov(own, rowvar=False))
    empty = points(spark, x[:0], groups[:0])
    assert pools.grouped_moments(empty, ["space"]).count() == 0


def test_partial_sums_are_given_up_when_groups_are_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pools, "HELD_GROUPS", 2)
    held = pools._rows({(str(i),): (1, np.zeros(2), np.zeros((2, 2))) for i in range(3)}, ["k"], [pa.string()])
    assert held.num_rows == 3 and held.schema.names == ["k", "n", "mean", "m2"]


def test_one_side_sets_the_space_of_both(spark, data):
    x, groups = data
    chosen = F.col("pid") % 2 == 0
    got = {r.pid: r.x for r in pools.fitted_on(points(spark, x, groups), ["space"], chosen, 2).collect()}
    assert len(got) == 120
    for g in "abc":
        at = np.flatnonzero(groups == g)
        base = x[at[at % 2 == 0]]
        _, _, axes = np.linalg.svd(base - base.mean(0), full_matrices=False)
        assert np.allclose(np.abs([got[i] for i in at]), np.abs((x[at] - base.mean(0)) @ axes[:2].T))
    with pytest.raises(Exception, match="axes need"):
        pools.fitted_on(points(spark, x[:3], groups[:3]), ["space"], chosen, 4).collect()


def test_spaces_hold_every_row_once(spark, data):
    x, groups = data
    both = pools.spaces(points(spark, x, groups).withColumnRenamed("space", "grp"), {"raw": lambda c: c, "unit": transforms.normalize})
    assert both.groupBy("space").count().orderBy("space").collect() == [("raw", 120), ("unit", 120)]
    assert both.where("space = 'unit'").agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0] == pytest.approx(1)


def test_folds_keep_groups_whole_and_balanced(spark):
    sizes = [50, 30, 30, 20, 20, 20, 10, 10, 5, 5]
    rows = spark.createDataFrame([(g, i) for g, s in enumerate(sizes) for i in range(s)] + [(None, 0)], "g long, i long")
    got = folds.balanced_folds(rows, "g", 3).collect()
    by_group = {g: {r.fold for r in got if r.g == g} for g in range(10)}
    assert all(len(f) == 1 for f in by_group.values()) and [r.fold for r in got if r.g is None] == [None]
    counts = [sum(1 for r in got if r.fold == f) for f in range(3)]
    assert max(counts) - min(counts) <= 50 and sum(counts) == 200


def test_ridge_of_all_folds_from_one_pass(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3)) * [1, 10, 0.1] + [0, 5, 2]
    y, fold = x @ [1.0, -0.2, 4.0] + rng.normal(size=90), np.arange(90) % 4
    rows = spark.createDataFrame([(i, *map(float, v), float(t), int(f)) for i, (v, t, f) in enumerate(zip(x, y, fold))] + [(99, None, 1.0, 1.0, 1.0, 0)], "i long, a double, b double, c double, y double, fold int")
    got = {r.i: (r.predicted, r.base) for r in folds.ridge_out_of_fold(rows, ["a", "b", "c"], "y").collect()}
    assert set(got) == set(range(90))
    for f in range(4):
        train = fold != f
        mean, sd = x[train].mean(0), x[train].std(0)
        z = (x - mean) / sd
        w = np.linalg.solve(z[train].T @ z[train] + np.eye(3), z[train].T @ (y[train] - y[train].mean()))
        for i in np.flatnonzero(fold == f):
            assert got[i] == pytest.approx((y[train].mean() + z[i] @ w, y[train].mean()))


def test_rates_by_level(spark):
    rows = spark.createDataFrame([(0.0, 1, 1.0), (0.0, 2, 0.0), (0.0, 2, 0.0), (0.5, 1, 1.0), (0.5, 3, None)], "alpha double, g long, hit double")
    got = {r.level: r for r in folds.rates_by_level(rows, "alpha", "g", {"rate": F.col("hit")}, 50).collect()}
    assert got[0.0].n == 3 and got[0.0]["mean"] == pytest.approx(1 / 3) and got[0.0].ci_low == 0.0 and got[0.0].ci_high == 1.0
    assert got[0.5].n == 1 and got[0.5].ci_low == got[0.5].ci_high == 1.0


def test_students_law(spark):
    # quantiles of printed tables
    table = {(1, 0.975): 12.7062, (2, 0.975): 4.30265, (5, 0.95): 2.01505, (10, 0.975): 2.22814, (30, 0.995): 2.75000, (120, 0.975): 1.97993}
    for (df, p), t in table.items():
        assert statistics.t_quantile(np.array([p]), np.array([float(df)]))[0] == pytest.approx(t, abs=6e-5)
        assert statistics.t_tail(np.array([t]), np.array([float(df)]))[0] == pytest.approx(1 - p, abs=1e-5)
    assert statistics.t_tail(np.array([0.0, -1.0]), np.array([1.0, 1.0])) == pytest.approx([0.5, 0.75])
    values = [("mmd", "control", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("mmd", "effect", v) for v in (3.0, 5.0, 7.0)]
    values += [("precision@1", "control", 1.0), ("precision@1", "effect", 0.5), ("js", "control", 1.0), ("js", "control", 1.0), ("js", "effect", 2.0), ("js", "effect", 2.0)]
    rows = spark.createDataFrame([(1, *v) for v in values], "n int, metric string, kind string, value double")
    got = {r.metric: r for r in statistics.welch_table(rows, ["n"]).collect()}
    mmd = got["mmd"]
    se = np.sqrt(5 / 3 / 4 + 4 / 3)
    df = se**4 / ((5 / 12) ** 2 / 3 + (4 / 3) ** 2 / 2)
    assert (mmd.delta, mmd.se, mmd.df) == pytest.approx((2.5, se, df)) and mmd.ci_low < 0 < mmd.ci_high
    assert mmd.ci_high - mmd.delta == pytest.approx(statistics.t_quantile(np.array([0.975]), np.array([df]))[0] * se)
    assert got["precision@1"].delta == pytest.approx(0.5) and got["precision@1"].ci_low is None and got["js"].p_value is None
