"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers x = floor(1024 c) + 100000, written once as blocks.  A pass over the blocks multiplies the centred
vectors with a thin matrix, BᵀBQ: every task adds up d x b numbers, tasks' sums are merged, and the driver gets d x b numbers.
The covariance itself is never formed.

The subspace is driven by polynomials: a Chebyshev recurrence of passes keeps the spectrum below the smallest Ritz value of the
block small and grows what lies above; then QR and Rayleigh-Ritz.  It ends when certified: the residuals of all components have
come down to ``TOLERANCE`` times the largest eigenvalue, and fresh random vectors, filtered in the same way and orthogonal to
the components, show no larger direction.  A block that gains too little in a round is doubled, up to the whole space, where
Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.llm.blocks import bound_batches
from nubes.plans.scratch import Scratch

SCALE, SHIFT = 1024, 100_000
#: Vectors of a block.
BLOCK = 4096
#: Tasks that merge the sums of all tasks before they go to the driver.
MERGERS = 4
TOLERANCE = 2e-14
#: Rounds until the block is the whole space at the latest, and the degrees of a round's polynomial.
ROUNDS, LEAST_DEGREE, MOST_DEGREE = 40, 2, 12
#: Columns beyond the wanted ones, and random vectors of the last test.
SPARE, PROBES = 12, 4
#: How much more a polynomial may grow the first component than the last one.
SPREAD = 1e10
LONG = 2**62


@dataclass(frozen=True)
class Model:
    """Components of one fit list: columns of ``vectors`` by falling ``values``; ``total`` is the trace, ``sums`` are exact."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float
    residual: float
    passes: int
    identity_error: float = float("nan")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows with a vector that has only finite entries, small enough that x is a long."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float(LONG // SCALE))))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding")).where(F.coalesce(fine, F.lit(False)))


def whole_blocks(batches):
    """vec_id, embedding to blocks: ids and the whole numbers x."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(SCALE * c).astype(np.int64) + SHIFT
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])


def numbers(batches, d: int):
    """(ids, x) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, np.frombuffer(batch.column(1)[i].as_buffer(), np.int64).reshape(-1, d)


def shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in longs where they hold it, else in Python's numbers."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * top + max(map(abs, sums), default=0) < LONG:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (shifted(x, n, sums) / n).astype(np.float64)


def deviations(moved: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if moved.dtype != object and moved.shape[1] * (float(np.abs(moved).max(initial=0)) ** 2) < LONG:
        return (moved * moved).sum(axis=1).tolist()
    return [sum(v * v for v in map(int, row)) for row in moved]


def exact_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S: whole numbers of any size, as decimals between tasks."""
    kind = pa.list_(pa.decimal128(38, 0))

    def run(batches):
        n, total = 0, [0] * d
        for _, x in numbers(batches, d):
            high, low = x >> 20, x & 0xFFFFF
            total = [t + (int(a) << 20) + int(b) for t, a, b in zip(total, high.sum(axis=0), low.sum(axis=0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([list(map(Decimal, total))], kind)], ["n", "s"])

    def merge(batches):
        n, total = 0, [0] * d
        for batch in batches:
            for row in batch.to_pylist():
                n, total = n + row["n"], [t + int(s) for t, s in zip(total, row["s"])]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([list(map(Decimal, total))], kind)], ["n", "s"])

    schema = "n long, s array<decimal(38,0)>"
    rows = blocks.mapInArrow(run, schema).repartition(MERGERS).mapInArrow(merge, schema).collect()  # MERGERS rows at most
    return sum(r.n for r in rows), [sum(int(r.s[k]) for r in rows) for k in range(d)]


def summed(blocks: DataFrame, d: int, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of a fixed number of doubles: by task, by merger, then on the driver, in order of the mergers."""

    def run(batches):
        total = None
        for _, x in numbers(batches, d):
            part = kernel(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["sums"])

    def merge(batches):
        total = None
        for batch in batches:
            for row in batch.column(0):
                part = row.values.to_numpy()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

    rows = blocks.mapInArrow(run, "sums array<double>").repartition(MERGERS).mapInArrow(merge, "sums array<double>").collect()
    return np.sum([r.sums for r in rows], axis=0)


def growth(degree: int, value: float, bound: float) -> float:
    """The Chebyshev polynomial at ``value`` when [0, bound] is mapped to [-1, 1]."""
    t = max(2 * value / bound - 1, 1.0)
    return float(np.cosh(min(degree * np.arccosh(t), 300.0)))


def filtered(apply: Callable, x: np.ndarray, vx: np.ndarray, degree: int, bound: float, top: float) -> np.ndarray:
    """The block after a polynomial of ``degree`` in the covariance, small on [0, bound] and 1 at ``top``; ``vx`` is its product already."""
    half = bound / 2
    scale = half / (top - half)
    first = scale
    before, now = x, (vx - half * x) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, 2 * after / half * (apply(now) - half * now) - scale * after * before
        scale = after
    return now


def components_of(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues, falling, their vectors, and the largest residual over the largest eigenvalue.

    ``apply`` multiplies a thin matrix with a symmetric non-negative operator.
    """
    rng = np.random.default_rng(seed)
    block = min(d, k + SPARE)
    x = np.linalg.qr(rng.normal(size=(d, block)))[0]

    def ritz(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = apply(x)
        h = x.T @ vx
        values, turn = np.linalg.eigh((h + h.T) / 2)
        turn = turn[:, ::-1]
        return values[::-1], x @ turn, vx @ turn

    def error(values: np.ndarray, x: np.ndarray, vx: np.ndarray) -> float:
        rest = np.sqrt(((vx - x * values)[:, :k] ** 2).sum(axis=0)).max(initial=0.0)
        return float(rest / max(values[0], 1e-300))

    values, x, vx = ritz(x)
    worst = error(values, x, vx)
    for turn in range(ROUNDS):
        if values[0] <= 0 or x.shape[1] == d:
            break
        bound = max(values[-1], 1e-13 * values[0])
        degrees = [m for m in range(LEAST_DEGREE, MOST_DEGREE + 1) if growth(m, values[0], bound) <= SPREAD * growth(m, values[k - 1], bound)] or [LEAST_DEGREE]
        enough = [m for m in degrees if growth(m, values[k - 1], bound) * TOLERANCE >= worst] or degrees[-1:]
        if worst <= TOLERANCE:
            probe = rng.normal(size=(d, PROBES))
            probe -= x[:, :k] @ (x[:, :k].T @ probe)
            probe = np.linalg.qr(probe)[0]
            probe = filtered(apply, probe, apply(probe), degrees[-1], bound, values[0])
            probe -= x[:, :k] @ (x[:, :k].T @ probe)
            probe = np.linalg.qr(probe)[0]
            if np.linalg.eigvalsh(probe.T @ apply(probe))[-1] <= values[k - 1] * (1 + 1e-9):
                break
            x[:, -PROBES:] = probe  # a direction that the block had missed
            values, x, vx = ritz(np.linalg.qr(x)[0])
        else:
            y = filtered(apply, x, vx, enough[0], bound, values[0])
            y = np.linalg.qr(y / np.sqrt((y * y).sum(axis=0)))[0]
            values, x, vx = ritz(y)
        now = error(values, x, vx)
        if now > TOLERANCE and now > worst / 4 and turn > 1:
            if now <= 50 * TOLERANCE:  # as far as sums in doubles go
                worst = now
                break
            x = np.linalg.qr(np.concatenate([x, rng.normal(size=(d, min(d, 2 * x.shape[1]) - x.shape[1]))], axis=1))[0]
            values, x, vx = ritz(x)
            now = error(values, x, vx)
        worst = now
    return np.maximum(values[:k], 0.0), x[:, :k], worst


def fit(blocks: DataFrame, d: int, components: int) -> Model:
    """The model of one table of blocks of vectors of length ``d``."""
    n, sums = exact_sums(blocks, d)
    k = min(components, d)
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def kernel(x: np.ndarray) -> np.ndarray:
            b = centred(x, n, sums)
            return b.T @ (b @ q)

        return summed(blocks, d, kernel).reshape(q.shape) / n

    total = float(summed(blocks, d, lambda x: (centred(x, n, sums) ** 2).sum(keepdims=True).ravel())[0] / n)
    values, vectors, residual = components_of(apply, d, k)
    real = values > 1e-13 * max(values[0], 1e-300)
    scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def kernel(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = summed(blocks, d, kernel) / n
    mean, square = got[:k], got[k:].reshape(k, k)
    off = np.abs(square - np.outer(mean, mean) - np.eye(k))[np.ix_(real, real)].max(initial=0.0)
    return Model(n, sums, np.where(real, values, 0.0), scaled, total, residual, passes, float(off))


def whiten(vectors: DataFrame, components: int = 8, log: list | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row of ``vectors`` (vec_id, embedding).

    deviation is exact, a decimal of 38 digits (null beyond).  Rows whose vector is null, or holds null or non-finite entries, take no part; nor
    do vectors with an entry of 2**52 or more, whose x is no long.  Vectors of different lengths are fit lists of their own.
    Repeated rows and ids count each; null ids stay null.  A component without variance (fewer distinct vectors than
    components, ties of all) has a null whitened value, explains 0 and is left out of identity_error; equal eigenvalues share
    their space in any basis.  Vectors without entries give no rows, nor does an empty table.  Other columns are ignored.
    ``log`` gets the models.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "whitening")
    base = usable(vectors)
    kind = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], kind)
    for (d,) in sorted(base.select(F.size("embedding").alias("d")).where("d > 0").distinct().collect()):
        rows = base.where(F.size("embedding") == d)
        blocks = scratch.keep(rows.mapInArrow(whole_blocks, "ids array<long>, x binary"), f"blocks_{d}")
        model = fit(blocks, d, components)
        if log is not None:
            log.append(model)
        out = out.unionByName(blocks.mapInArrow(projected(model, d), kind))
    return out


def projected(model: Model, d: int) -> Callable:
    k = len(model.values)
    explained = model.values / model.total if model.total > 0 else np.zeros(k)

    def run(batches):
        for ids, x in numbers(batches, d):
            moved = shifted(x, model.n, model.sums)
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in deviations(moved)], pa.decimal128(38, 0))
            white = (moved / model.n).astype(np.float64) @ model.vectors
            rows = len(x)
            take = pa.array(np.repeat(np.arange(rows), k))
            none = np.tile(model.values <= 0, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), deviation.take(take),
                    pa.array(white.ravel(), mask=none), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run
