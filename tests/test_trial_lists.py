import numpy as np

from nubes.operators import trial_neighbours, trials
from nubes.plans import trial_queries


def shares(x, w_own, w_other, k, atol=1e-12):
    """Weight of the other side's points in the balls of a side's points, each point counted as often as its weight says."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    covered = np.zeros(len(x), bool)
    for i in np.flatnonzero(w_own):
        order = np.argsort(d[i], kind="stable")
        counts = np.cumsum(w_own[order] - (order == i))
        covered |= d[i] <= d[i][order[np.argmax(counts >= k)]] + atol
    return (w_other * covered).sum() / w_other.sum()


def test_only_points_with_short_lists_get_longer_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    w = np.zeros((300, 2, 2), int)  # points, trials, sides
    w[:14, :, 0] = 1  # few of P among many of Q, so lists of 56 hold too few of P
    w[14:, :, 1] = 1
    w[:14, 1, 0] = rng.integers(0, 4, 14)
    w[14:, 1, 1] = rng.integers(0, 4, 286)
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, x array<double>")
    rows = [(i, t, "pq"[s], int(w[i, t, s])) for i in range(300) for t in (0, 1) for s in (0, 1) if w[i, t, s]]
    points = trials.weighted(pool, spark.createDataFrame(rows, "pid long, trial int, side string, w int"))
    calls, inner = [], trial_neighbours.nearest_points
    monkeypatch.setattr(trial_neighbours, "nearest_points", lambda *a: calls.append(a[1]) or inner(*a))
    found = {(r.metric, r.trial): r.value for r in trial_neighbours.trial_neighbours(points, 2, (1, 3, 10), 5).collect()}
    assert calls == [56]
    for t in (0, 1):
        for k in (1, 3, 10):
            assert found[f"precision_{k}", t] == shares(x, w[:, t, 0], w[:, t, 1], k)
            assert found[f"recall_{k}", t] == shares(x, w[:, t, 1], w[:, t, 0], k)


def test_values_are_written_before_they_are_read_again(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, x array<double>")
    values = trial_queries._all_values(pool, trials.relabelled(pool, 30, 2, 1), 3)
    assert "MapInArrow" not in values._jdf.queryExecution().toString()
    assert {(r.metric, r.trial) for r in values.collect()} >= {(m, t) for m in ("energy", "mmd", "js", "recall_3") for t in range(3)}
