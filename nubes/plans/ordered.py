"""Ranks and running sums inside groups of any size.

A window partitioned by a group's key puts the whole group into one task; a group that holds a third of all rows would not
fit.  Here rows are range-partitioned by key and order, so one group spans as many tasks as it needs.  Each task counts its
part, the parts' totals (one row for each part and key) are summed up in order, and every row adds what stands before its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubes.plans.scratch import Scratch


def parts_in_order(df: DataFrame, keys: list[str], order: list, name: str = "ordered") -> DataFrame:
    """``df`` with its range partition as column ``part_``; written once, so that the partition of a row is settled."""
    dealt = df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id())
    return Scratch(df.sparkSession, name).keep(dealt, "parts")


def running(df: DataFrame, keys: list[str], order: list, sums: dict, inclusive: bool = True) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name: column to add up): the sum over the rows of the same keys that come
    before in ``order``, and the row itself if ``inclusive``.

    ``order`` should end with something unique; rows equal in all of it count in any order.  Null keys form a group.
    """
    rows = parts_in_order(df.withColumns({f"{s}_own": c for s, c in sums.items()}), keys, order)
    totals = rows.groupBy("part_", *keys).agg(*(F.sum(f"{s}_own").alias(f"{s}_part") for s in sums))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("part_").alias("at_"), *(F.col(k).alias(f"of_{k}") for k in keys),
        *(F.coalesce(F.sum(f"{s}_part").over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums),
    )
    end = 0 if inclusive else -1
    inside = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    within = rows.withColumns({f"{s}_own": F.coalesce(F.sum(f"{s}_own").over(inside), F.lit(0)) for s in sums})
    same = F.col("part_") == F.col("at_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    joined = within.join(totals, same)
    return joined.select(*df.columns, *((F.col(f"{s}_own") + F.col(f"{s}_before")).alias(s) for s in sums))


def ranked(df: DataFrame, keys: list[str], order: list, rank: str = "rank") -> DataFrame:
    """``df`` with its place, from 1, among the rows of the same keys."""
    return running(df, keys, order, {rank: F.lit(1).cast("long")})


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str = "rank") -> DataFrame:
    """``df`` with the rank of ``value`` among the rows of the same keys; equal values share the mean of their places.

    Values are counted before they are ordered, so a value that most rows have costs no more than a rare one.
    """
    times = df.groupBy(*keys, value).agg(F.count("*").alias("times_"))
    places = running(times, keys, [value], {"upto_": F.col("times_")})
    places = places.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col(value).alias("of_value"), (F.col("upto_") - (F.col("times_") - 1) / 2.0).alias(rank))
    same = F.col(value).eqNullSafe(F.col("of_value"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return df.join(places, same).select(*df.columns, rank)


def order_statistics(df: DataFrame, keys: list[str], value: str, levels: dict[str, tuple[float, str]]) -> DataFrame:
    """One row for each key with, per name in ``levels``, the observed value at quantile q: the order statistic at
    (n - 1) * q, rounded up ('higher') or down ('lower').  Null and NaN values don't count."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("times_"))
    upto = running(clean, keys, [value], {"upto_": F.col("times_")})
    sizes = clean.groupBy(*keys).agg(F.sum("times_").alias("n_"))
    sizes = sizes.select(*(F.col(k).alias(f"of_{k}") for k in keys), "n_")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    rows = upto.join(sizes, same) if keys else upto.crossJoin(F.broadcast(sizes))
    found = []
    for name, (q, way) in levels.items():
        place = (F.ceil if way == "higher" else F.floor)((F.col("n_") - 1) * F.lit(float(q))) + 1
        found.append(F.min(F.when(F.col("upto_") >= place, F.col(value))).alias(name))
    return rows.groupBy(*keys).agg(*found)


def linear_quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """One row for each key with, per name in ``levels``, the quantile q between the two order statistics around (n - 1) * q, by their
    distance from it."""
    ends = {}
    for name, q in levels.items():
        ends |= {f"{name}_low": (q, "lower"), f"{name}_high": (q, "higher")}
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias(value))
    stats = order_statistics(clean, keys, value, ends)
    sizes = clean.groupBy(*keys).agg(F.count("*").alias("n_"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    sizes = sizes.select(*(F.col(k).alias(f"of_{k}") for k in keys), "n_")
    rows = stats.join(sizes, same) if keys else stats.crossJoin(F.broadcast(sizes))
    place = lambda q: (F.col("n_") - 1) * F.lit(float(q))
    cells = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place(q) - F.floor(place(q)))).alias(name) for name, q in levels.items()]
    return rows.select(*keys, *cells)
