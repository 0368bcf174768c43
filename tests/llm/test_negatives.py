"""Hard negatives against scores of all pairs."""

import numpy as np
import pytest

from nubes.llm import negatives, queries

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label long, embedding array<double>"


def brute(rows, anchors, positives=5, k=10, low=30, high=90, base=100):
    """``rows`` and ``anchors``: (id, label, vector) with distinct ids."""
    v = {i: (label, [int(np.floor(256 * float(c))) for c in x]) for i, label, x in rows}
    out = []
    for a, label, _ in anchors:
        scores = sorted(((-sum(p * q for p, q in zip(v[a][1], x)), i, other) for i, (other, x) in v.items() if i != a and len(x) == len(v[a][1])))
        for s, pid, _ in [r for r in scores if r[2] == label][:positives]:
            inside = [r for r in scores if r[2] != label and low * -s <= base * -r[0] <= high * -s][:k]
            out += [(a, pid, rank + 1, i, -s, -n) for rank, (n, i, _) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, anchors, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(table, spark.createDataFrame(anchors, SCHEMA), **more).collect()))


@pytest.mark.parametrize("d", [5, 64, 100])
def test_negatives_are_those_of_all_pairs(spark, d):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(4, d))
    rows = [(i, int(c), (centres[c] + rng.normal(size=d) * 0.8).round(2).tolist()) for i, c in enumerate(rng.integers(0, 4, 400))]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(40)]  # ties
    anchors = rows[::20] + rows[-2:]
    want = brute(rows, anchors)
    assert len(want) > 100
    assert found(spark, rows, anchors) == want
    assert found(spark, rows, anchors, positives=2, negatives=3, low=50, high=100) == brute(rows, anchors, 2, 3, 50, 100)


def test_query_on_whole_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, DATA).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 100 == 0])


def test_intervals_hold_every_product():
    rng = np.random.default_rng(1)
    for d, x in ((64, rng.normal(size=(500, 64)) * 200), (70, rng.normal(size=(300, 70)) ** 3), (8, np.ones((4, 8))), (3, np.zeros((2, 3)))):
        codes = negatives.Codes(*negatives.encode(x), d)
        spread = []
        for q in [*x[:20], -x[0], np.eye(d)[0]]:
            anchor, size = negatives.planes_of(q), float(np.sqrt(q @ q))
            mid, wide = np.zeros(len(x)), np.zeros(len(x))
            for level in range(negatives.LEVELS):
                low, high, mid, wide = codes.intervals(np.arange(len(x)), level, mid, wide, anchor, size)
                assert ((low <= x @ q) & (x @ q <= high)).all()
                spread.append((high - low).mean())
        assert spread[2] < spread[0] or d < 10


def test_edges(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.5, 0.0]), (4, 2, [0.9, 3.0]), (5, None, [0.5, 0.0]), (6, 2, None), (7, 2, [nan, 0.0]), (8, 2, [None, 0.0])]
    rows += [(None, 2, [0.5, 0.0]), (9, 2, [0.5, 0.0, 0.0]), (10, 2, [1e30, 0.0]), (11, 2, []), (2, 2, [0.5, 0.0]), (3, 3, [9.0, 0.0]), (12, 5, [0.5, 0.5])]
    want = [(0, 1, 1, 4, 65536, 58880), (0, 1, 2, 2, 65536, 32768), (0, 1, 3, 3, 65536, 32768), (0, 1, 4, 12, 65536, 32768)]
    assert found(spark, rows, rows[:1]) == want
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS score", "3 AS d", "4 AS g")
    assert sorted(map(tuple, negatives.hard_negatives(table, table.where("vec_id IN (0, 12)")).collect())) == want
    assert negatives.hard_negatives(table.limit(0), table).count() == 0
    assert negatives.hard_negatives(table, table.where("vec_id = 6")).count() == 0
