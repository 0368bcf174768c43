"""Whitening against a dense eigen-decomposition and exact sums."""

import math

import numpy as np
import pytest

from nubes.llm import queries, whitening

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


def check(rows, vectors, k=8):
    """``rows`` of vectors {id: list} of one length, against numpy."""
    ids = sorted(vectors)
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in vectors[i]] for i in ids], object)
    n, sums = len(ids), x.sum(axis=0)
    b = np.array((x * n - sums) / n, float)
    values, axes = np.linalg.eigh(b.T @ b / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, len(values))
    assert len(rows) == n * k
    for c in range(k):
        mine = sorted((r for r in rows if r.component == c + 1), key=lambda r: r.vec_id)
        assert [r.vec_id for r in mine] == ids and {r.n for r in mine} == {n}
        assert [int(r.deviation) for r in mine] == [int(((row * n - sums) ** 2).sum()) for row in x]
        want, got = b @ axes[:, c] / math.sqrt(values[c]), np.array([r.whitened for r in mine])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert mine[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert mine[0].identity_error < 1e-9


def test_query_equals_a_dense_solution(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    check(queries.op11_whitened_vectors(spark, DATA).collect(), {r.vec_id: r.embedding for r in table})


def test_separated_and_close_spectra(spark):
    rng = np.random.default_rng(3)
    for scales in (np.geomspace(30, 0.01, 40), np.concatenate([[9, 8.999], np.full(38, 1.0)])):
        x = rng.normal(size=(300, 40)) * scales
        log = []
        rows = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), 8, log).collect()
        assert log[0].residual < 1e-12
        check(rows, dict(enumerate(x)))


def test_certificate_holds_a_missed_direction():
    """The start is perpendicular to the first component but for rounding: fresh vectors have to find it."""
    d = 30
    values = np.concatenate([[100.0], np.linspace(9, 1, d - 1)])
    axes = np.linalg.qr(np.random.default_rng(0).normal(size=(d, d)))[0]
    v = (axes * values) @ axes.T
    got, vectors, residual = whitening.components_of(lambda q: v @ q, d, 3)
    assert np.allclose(got, values[:3], rtol=1e-12) and residual < 1e-12
    assert np.allclose(np.abs(vectors.T @ axes[:, :3]), np.eye(3), atol=1e-10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (2, [3.0, 5.0]), (None, [4.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1e300, 0.0])]
    rows += [(9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS component", "0.5 AS deviation")
    got = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)] + [(i, c) for i in (9, 10) for c in (1, 2, 3)]
    assert {r.n for r in got if r.vec_id in (9, 10)} == {2} and {r.n for r in got if r.vec_id == 1} == {4}
    assert all(r.whitened is None and r.explained == 0.0 and r.deviation == 0 for r in got if r.vec_id in (9, 10))
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(table.limit(0)).count() == 0
    one = whitening.whiten(table.where("vec_id = 1")).collect()
    assert [(r.n, r.whitened) for r in one] == [(1, None), (1, None)]


def test_whole_numbers_beyond_longs():
    x = np.array([[2**61, 5], [-(2**61), 7]])
    sums = [0, 12]
    moved = whitening.shifted(x, 2, sums)
    assert moved.tolist() == [[2**62, -2], [-(2**62), 2]]
    assert whitening.deviations(moved) == [2**124 + 4] * 2
