"""Links between things that share a key, and the components those links make, without all pairs of a group.

``resolve`` gets the groups of ``meetings``: only items of a common group can be linked.  It first compares every item with the
smallest one of the group that it shares most with, then joins what is linked into components, repeats that with another
representative of each group, and at last compares those pairs of a group that are still in different components.  Pairs inside a component need no comparison,
since they cannot change it.  The result is that of comparing all pairs under a common key.

In the last step the items of keys that hold many are dealt into blocks of bounded content.  Blocks that meet under a key are
compared as a whole inside a task, which returns only links that join components; no row stands for a pair of items.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.plans.scratch import Scratch

#: Keys of more open items than this are compared in blocks; those of fewer give at most this many pairs an item.
PAIRS_UP_TO = 8
#: A block holds about this many tokens or characters (the sizes of its items), and 8 to 512 items.
BLOCK_SIZE = 1 << 17
#: Buckets of keys for each shuffle partition; keys that a task packs at a time; keys of one bucket that a task sorts.
BUCKETS = 4
PACKED = 1 << 20
SORTED_UP_TO = 1 << 22
#: Leading bits of the kept half of a key by which a larger bucket is split.
SPLIT_BITS = 8


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "m").cast("decimal(20,0)")), F.lit(0))).first()
    return row[0], row[1]


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(item, component) for every item of the links (a, b) that isn't the smallest of its component.

    Alternating large-star and small-star steps: each vertex hands its larger, then its smaller neighbours to its smallest
    one.  Both are a minimum per vertex and a join back; no neighbourhood is gathered.  Ends when a round changes nothing.
    """
    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v > m").distinct(), f"{name}_0"
    )
    state = _digest(edges)
    turn = 0
    while state[0]:
        both = edges.unionAll(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least"))
        least = least.select("u", F.least("u", "least").alias("least"))
        large = both.where("m > v").join(least, F.col("v") == F.col("u")).select(F.col("m").alias("v"), F.col("least").alias("m"))
        large = large.where("v > m").distinct()
        lowest = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least"))
        small = large.join(lowest, F.col("v") == F.col("u"))
        small = small.select("m", "least").unionAll(small.select("v", "least")).toDF("v", "m").where("v > m").distinct()
        turn += 1
        edges = scratch.keep(small, f"{name}_{turn}")
        scratch.drop(f"{name}_{turn - 1}")
        after = _digest(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("v").alias("item"), F.col("m").alias("component"))


def with_least(batches):
    """(rep, item) of the rows (key, item), sorted, that aren't the first of their key; ``rep`` is that first item."""
    last_key = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, item = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.append(last_key is None or key[0] != last_key, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        least = item[start]
        least[start < 0] = last if last is not None else 0  # the key goes on from the batch before
        last_key, last = key[-1], least[-1]
        more = item > least
        yield pa.RecordBatch.from_arrays([pa.array(least[more]), pa.array(item[more])], ["rep", "item"])


def packed(keys: np.ndarray, items: np.ndarray, buckets: int) -> list[pa.Array]:
    """bucket, keys, items: a row a bucket instead of one a key.  The upper half of a key gives its bucket, the lower is kept.

    Keys of a bucket that agree in the lower half only become one; their items are candidates more, and are compared as all are.
    """
    return in_buckets((keys >> np.uint64(32)) % np.uint64(buckets), keys.astype(np.uint32), items, buckets)


def in_buckets(bucket: np.ndarray, keys: np.ndarray, items: np.ndarray, buckets: int) -> list[pa.Array]:
    """The rows of ``packed`` for keys whose buckets are given."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    count = np.bincount(bucket.astype(np.int64), minlength=buckets)
    there = np.flatnonzero(count)
    at = np.append(0, np.cumsum(count[there]))
    columns = [pa.array(there.astype(np.int32))]
    for x in (keys[order], items[order]):
        columns.append(pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]))
    return columns


def least_of_keys(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rep, item as ``with_least`` gives them, from keys in any order."""
    order = np.argsort(keys)
    ordered = keys[order]
    again = ordered[1:] == ordered[:-1]
    often = np.append(again, False) | np.append(False, again)
    keys, items = ordered[often], items[order[often]]
    order = np.lexsort((items, keys))
    keys, items = keys[order], items[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    least = np.repeat(items[first], np.diff(np.append(first, len(keys))))
    return least[items > least], items[items > least]


MET = "rep long, item long, key long, bucket int, keys binary, items binary"


def met_in_buckets(most: int, splits: bool):
    """``MET`` from the rows of ``packed``, sorted by bucket: (rep, item); of buckets with more than ``most`` keys the rows (bucket, keys,
    items) of smaller buckets if ``splits``, (key, item) to be sorted as rows if not."""
    names = [column.split()[0] for column in MET.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.binary()]

    def record(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kind)) for c, kind in zip(names, kinds)], names)

    def unpacked(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.frombuffer(x[k].as_buffer(), kind) for x in rows]) for k, kind in ((0, np.uint32), (1, np.int64)))

    def met(rows: list) -> pa.RecordBatch:
        rep, item = least_of_keys(*unpacked(rows))
        return record(rep=pa.array(rep), item=pa.array(item))

    def too_many(bucket: int, rows: list) -> pa.RecordBatch:
        key, item = unpacked(rows)
        if not splits:
            return record(item=pa.array(item), key=pa.array(key.astype(np.int64) | (bucket << 32)))
        part, keys, items = in_buckets(key >> np.uint32(32 - SPLIT_BITS), key, item, 1 << SPLIT_BITS)
        return record(bucket=pa.array(part.to_numpy() + np.int32(bucket << SPLIT_BITS)), keys=keys, items=items)

    def run(batches):
        held, n, current, wide = [], 0, None, False
        for batch in batches:
            for bucket, row in zip(batch.column(0).to_pylist(), zip(batch.column(1), batch.column(2))):
                if bucket != current:
                    if held:
                        yield met(held)
                    held, n, current, wide = [], 0, bucket, False
                held.append(row)
                n += len(row[0].as_buffer()) // 4
                wide |= n > most
                if wide:
                    yield too_many(bucket, held)
                    held = []
        if held:
            yield met(held)

    return run


def meetings(keys: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, item, shared) from the rows of ``packed``: each item stands with the smallest item of every key that others have too.

    The new ``key`` is that smallest item, which is in its group as well; ``shared`` counts the keys that brought an item there.
    Items with a common key have a common smallest item, so these groups hold every pair that the keys held, in far fewer rows.
    One shuffle of packed keys; a task sorts a bucket at a time.  Buckets with more than ``SORTED_UP_TO`` keys, as in large tables or few
    partitions, are split and shuffled again, still packed.  Of those parts the ones that are too large again, as under a key that very
    many items have, are shuffled as rows and pass in the order of their keys; no key's rows are held.
    """
    in_order = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    found = scratch.keep(in_order(keys).mapInArrow(met_in_buckets(SORTED_UP_TO, True), MET), f"{name}_met")
    rows, wide = found.where("rep IS NOT NULL").select("rep", "item"), found.where("bucket IS NOT NULL").select("bucket", "keys", "items")
    if not wide.isEmpty():
        found = scratch.keep(in_order(wide).mapInArrow(met_in_buckets(SORTED_UP_TO, False), MET), f"{name}_split")
        rows, wide = rows.unionAll(found.where("rep IS NOT NULL").select("rep", "item")), found.where("key IS NOT NULL").select("key", "item")
        if not wide.isEmpty():
            rows = rows.unionAll(wide.repartition("key").sortWithinPartitions("key", "item").mapInArrow(with_least, "rep long, item long"))
    rows = rows.groupBy("rep", "item").count()
    own = F.struct("item", F.col("count").alias("shared"))
    rows = rows.select(F.col("rep").alias("key"), F.explode(F.array(own, F.struct(F.col("rep").alias("item"), F.lit(0).cast("long").alias("shared")))).alias("x"))
    met = scratch.keep(rows.groupBy("key", "x.item").agg(F.max("x.shared").alias("shared")), name)
    scratch.drop(f"{name}_met", f"{name}_split")
    return met


def joining(compare: Callable[[list, list, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """A task's work on pairs of blocks (a, b, left, right): links (a, b) of items that join components of the two."""

    def links(left: pa.StructArray, right: pa.StructArray, alone: bool) -> list[tuple[int, int]]:
        items, components, contents = ([x.field(k) for x in (left, right)] for k in ("item", "component", "content"))
        items, components = ([x.to_numpy() for x in two] for two in (items, components))
        may = components[0][:, None] != components[1][None, :]
        if alone:
            may &= np.tri(len(left), k=-1, dtype=bool)
        i, j = compare(contents[0].to_pylist(), contents[1].to_pylist(), may)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        out = []
        for x, y in zip(i.tolist(), j.tolist()):
            one, two = find(int(components[0][x])), find(int(components[1][y]))
            if one != two:
                root[max(one, two)] = min(one, two)
                pair = int(items[0][x]), int(items[1][y])
                out.append((min(pair), max(pair)))
        return out

    def run(batches):
        for batch in batches:
            a, b, left, right = batch.columns
            for k in range(batch.num_rows):
                found = links(left[k].values, right[k].values, a[k] == b[k])
                yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return run


def block_links(large: DataFrame, contents: Callable[[DataFrame], DataFrame], compare: Callable, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components, from the rows (key, item, size, component, n) of keys with n items.

    An item's block is a part of its largest key's items of like size; parts follow a hash, so no key's items are gathered.
    """
    band = F.expr("cast(log2(greatest(size, 1)) AS int)")
    homes = large.groupBy("item", "size", "component").agg(F.max(F.struct("n", "key")).alias("home")).withColumn("band", band)
    parts = F.expr(f"cast(ceil(home.n / greatest(8, least(512, {BLOCK_SIZE} / power(2, band)))) AS bigint)")
    homes = homes.select("item", "component", F.xxhash64("home.key", "band", F.pmod(F.xxhash64("item"), parts)).alias("block"))
    homes = scratch.keep(homes, "blocks")
    held = large.select("key", F.col("item").alias("of")).join(homes, F.col("of") == F.col("item"))
    held = held.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    meets = held.toDF("key", "a", "low", "high").join(held.toDF("key", "b", "low_b", "high_b"), "key")
    meets = meets.where("a <= b AND least(low, low_b) < greatest(high, high_b)").select("a", "b").distinct()
    meets = scratch.keep(meets, "block_pairs")
    # one row holds one block, whose content is bounded
    members = homes.join(contents(homes.select("item")), "item").groupBy("block").agg(F.collect_list(F.struct("item", "component", "content")).alias("members"))
    members = scratch.keep(members, "members")
    both = meets.join(members.toDF("a", "left"), "a").join(members.toDF("b", "right"), "b").select("a", "b", "left", "right")
    return both.mapInArrow(joining(compare), "a long, b long")


def resolve(met: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: F.Column, scratch: Scratch, contents: Callable[[DataFrame], DataFrame], compare: Callable) -> DataFrame:
    """(item, component) of linked items from the rows of ``meetings``, with the ``size`` of each item.

    ``verify`` gets distinct pairs (a, b) and returns those linked.  ``fits`` is a condition on the sizes ``size_a`` and
    ``size_b`` that every link fulfils.  ``contents`` gets distinct items (item) and returns (item, content); ``compare`` gets
    the contents of two blocks and a matrix of pairs to look at, and returns the positions of those linked.
    """
    # turn 0: each item with the smallest one of the group that it shares most keys with
    reps = met.where("item = key").select(F.col("key").alias("rep"), F.col("size").alias("size_b"))
    near = met.where("item <> key").withColumnRenamed("size", "size_a").join(reps, F.col("key") == F.col("rep")).where(fits)
    pairs = near.groupBy("item").agg(F.max_by("key", F.struct("shared", "key")).alias("b")).select(F.col("item").alias("a"), "b")
    links = scratch.keep(verify(pairs), "links_0")
    joined = components(links, scratch, "joined_0")
    for turn in (1, 2):
        # keys that still hold several components, each item with its component
        root = joined.select(F.col("item").alias("of"), "component")
        rows = met.join(root, met.item == root.of, "left").select("key", "item", "size", F.coalesce("component", "item").alias("component"))
        rows = scratch.keep(rows, f"open_{turn}")
        split = rows.groupBy("key").agg(F.min(F.struct("component", "item", "size")).alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low.component < high")
        if turn == 1:
            # every item against the first item of the first component under each of its keys
            rows = rows.join(split.select(F.col("key").alias("k"), "low"), F.col("key") == F.col("k")).where("component <> low.component")
            pairs = rows.withColumnRenamed("size", "size_a").withColumn("size_b", F.col("low.size")).where(fits).select("item", F.col("low.item").alias("other"))
        else:
            rows = scratch.keep(rows.join(split.select("key", "n"), "key"), "split")
            left = rows.where(F.col("n") <= PAIRS_UP_TO).drop("n")
            right = left.toDF("key", "item_b", "size_b", "component_b")
            both = left.withColumnRenamed("size", "size_a").join(right, "key").where("component < component_b").where(fits)
            pairs = both.select("item", F.col("item_b").alias("other"))
        pairs = pairs.select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).distinct()
        more = scratch.keep(verify(pairs), f"links_{turn}")
        scratch.drop(f"open_{turn}")
        if turn == 2:
            large = rows.where(F.col("n") > PAIRS_UP_TO)
            if not large.isEmpty():
                more = more.unionAll(scratch.keep(block_links(large, contents, compare, scratch), "links_blocks"))
        if not more.isEmpty():
            links = links.unionAll(more)
            joined = components(links, scratch, f"joined_{turn}")
    return joined
