"""Pools of vectors in several spaces, moments of many groups at once, and one projection for each group.

Moments of all groups come from one pass: tasks hold the centred sums of some groups, give them up when there are many, and the parts
of a group are merged where they meet in order.  A group's axes are a row of a table, applied to its points by a join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubes.operators.clouds import merged

#: Groups whose sums a task holds at once.
HELD_GROUPS = 256


def spaces(points: DataFrame, maps: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Every row once in each space: column ``space``, and ``x`` mapped into it."""
    cells = [F.struct(F.lit(name).alias("space"), change(F.col("x")).alias("x")) for name, change in maps.items()]
    rest = [c for c in points.columns if c != "x"]
    return points.select(*rest, F.explode(F.array(*cells)).alias("c")).select("c.space", *rest, "c.x")


def _sums_schema(points: DataFrame, keys: list[str]) -> str:
    kinds = dict(points.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, mean array<double>, m2 array<double>"


def _rows(held: dict[tuple, tuple], keys: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
    n, mean, m2 = zip(*held.values())
    return pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array([m.tolist() for m in mean]), pa.array([m.ravel().tolist() for m in m2])], [*keys, "n", "mean", "m2"])


def grouped_moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, mean, m2): of the vectors ``x`` of every group, m2 being the centred products, d x d numbers row by row."""
    schema = _sums_schema(points, keys)

    def run(batches):
        held: dict[tuple, tuple] = {}
        for batch in batches:
            types = [batch.column(i).type for i in range(len(keys))]
            codes: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys))))):
                codes.setdefault(key, []).append(i)
            for key, at in codes.items():
                part = batch.column(len(keys)).take(pa.array(at))
                x = np.asarray(part.flatten(), np.float64).reshape(len(at), -1)
                mean = x.mean(axis=0)
                held[key] = merged(held.get(key, (0, None, None)), (len(x), mean, (x - mean).T @ (x - mean)))
            if len(held) > HELD_GROUPS:
                yield _rows(held, keys, types)
                held = {}
        if held:
            yield _rows(held, keys, types)

    def merge(batches):
        """Rows come ordered by key, so one group at a time is held."""
        now, total, types = None, (0, None, None), []
        for batch in batches:
            types = [batch.column(i).type for i in range(len(keys))]
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                mean = np.array(row["mean"])
                part = (row["n"], mean, np.array(row["m2"]).reshape(len(mean), -1))
                if now is not None and key != now:
                    yield _rows({now: total}, keys, types)
                    total = (0, None, None)
                now, total = key, merged(total, part)
        if now is not None:
            yield _rows({now: total}, keys, types)

    parts = points.select(*keys, "x").mapInArrow(run, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def fit_axes(moments: DataFrame, k: int) -> DataFrame:
    """``moments`` with axes (the first k principal ones, each with its largest part positive) and shares (of all variances) in place of m2.
    A group with fewer than k points or components is an error."""
    keys = [c for c in moments.columns if c not in ("n", "mean", "m2")]
    kinds = dict(moments.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n long, mean array<double>, axes array<array<double>>, shares array<double>"

    def run(batches):
        for batch in batches:
            axes, shares = [], []
            for row in batch.to_pylist():
                d = len(row["mean"])
                if k > min(row["n"], d):
                    raise ValueError(f"{k} axes need as many points and components")
                values, vectors = np.linalg.eigh(np.array(row["m2"]).reshape(d, d) / max(row["n"] - 1, 1))
                own = vectors[:, ::-1].T
                own = own * np.sign(own[np.arange(d), np.abs(own).argmax(axis=1)])[:, None]
                values = np.maximum(values[::-1], 0)
                axes.append(own[:k].tolist())
                shares.append((values / max(values.sum(), 1e-300)).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys) + 2)), pa.array(axes, pa.list_(pa.list_(pa.float64()))), pa.array(shares, pa.list_(pa.float64()))], [*keys, "n", "mean", "axes", "shares"])

    return moments.select(*keys, "n", "mean", "m2").mapInArrow(run, schema)


def project(points: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with ``x`` in the axes of their group's model; points of groups without one are left out.

    Models stay on the JVM side: a row refers to its group's axes, and no matrix is copied for a row.
    """
    both = points.join(models.select(*keys, "mean", "axes"), keys)
    moved = both.withColumn("moved_", F.zip_with("x", "mean", lambda v, m: v - m))
    along = F.transform("axes", lambda a: F.aggregate(F.zip_with("moved_", a, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v))
    return moved.withColumn("x", along).select(*points.columns)


def fitted_on(points: DataFrame, keys: list[str], chosen: Column, k: int) -> DataFrame:
    """Every group of ``points`` in the first k axes of its ``chosen`` rows alone, as when one side of a pair sets the space of both."""
    return project(points, fit_axes(grouped_moments(points.where(chosen), keys), k), keys)
