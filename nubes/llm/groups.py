"""Links of token sets that share a key, found group by group inside tasks, without a row for a pair of a group.

``incidences`` turns rows (key, item, size) into (rep, item): under each key the items stand with its smallest one, the key's
representative.  Items with a common key have a common representative, so the groups of representatives hold every candidate
pair, and there are far fewer of them than keys.  ``resolve`` joins the items of these groups:

* a pass over sketches.  A task gets a group, or two chunks of a large one, as a matrix of bucket counts; the products of such
  matrices bound every intersection from above.  Of the pairs that can be linked it returns only a forest, most similar first.
* the forest's pairs are verified on the sets themselves.  Where all of them are links, every other pair that can be linked lies
  inside a component already.  Otherwise a second pass does the same between the components found, and a last one compares
  the sets of what is still open in the tasks and returns the links that join components.

The result is that of comparing all pairs with a common key.  Groups are split by size (powers of two; linked sets differ by
a third at most, so a set near the end of its range is also a guest of the next) and into chunks of bounded content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubes.llm.blocks import U64
from nubes.llm.components import components
from nubes.plans.scratch import Scratch

#: A chunk holds about this many tokens, and 16 to 1024 items.
CHUNK_TOKENS = 1 << 18
#: 64-bit words of the filter that texts pass before they are cut up again, at any size of the table.
FILTER_WORDS = 1 << 18
#: Columns of a matrix product at a time.
COLUMNS = 1 << 14
PERCENT = 75


def incidences(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(rep, item) for the rows (key, item, size) whose key two items or more have; the representative is in its group too."""
    inside = Window.partitionBy("key").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    rows = members.select("item", F.first("item").over(inside).alias("rep")).where("item > rep").groupBy("rep", "item").count()
    # one table instead of a union of two relations with one partitioning, whose partitions adaptive execution may change apart
    return scratch.keep(rows.select("rep", F.explode(F.array("item", "rep")).alias("item")).distinct(), name)


def sketch(s: np.ndarray) -> bytes:
    """How many tokens of a set fall into each hash bucket, half a byte a bucket; buckets are at least as many as tokens.

    Sums of bucket-wise minima bound an intersection from above.
    """
    buckets = max(64, 1 << len(s).bit_length())
    while True:
        counts = np.bincount((s & U64(buckets - 1)).astype(np.int64), minlength=buckets)
        if counts.max(initial=0) < 16:
            counts = counts.astype(np.uint8)
            return (counts[0::2] | (counts[1::2] << 4)).tobytes()
        buckets *= 2


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """The counts of sketches as a matrix; longer ones are folded onto the shortest."""
    width = 2 * min(map(len, sketches))
    out = np.empty((len(sketches), width), np.uint16)
    for row, x in enumerate(sketches):
        half = np.frombuffer(x, np.uint8)
        counts = np.empty(2 * len(half), np.uint8)
        counts[0::2], counts[1::2] = half & 15, half >> 4
        out[row] = counts.reshape(-1, width).sum(axis=0, dtype=np.uint16) if len(counts) > width else counts
    return out


def most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the minima of all pairs of rows of two count matrices."""
    total = np.zeros((len(x), len(y)), np.float32)
    for level in range(1, int(min(x.max(initial=0), y.max(initial=0))) + 1):
        a, b = x >= level, y >= level
        columns = np.flatnonzero(a.any(axis=0) & b.any(axis=0))
        for k in range(0, len(columns), COLUMNS):
            part = columns[k : k + COLUMNS]
            total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def by_sketches(left: list[bytes], right: list[bytes]) -> np.ndarray:
    wide = unpacked(left + right)
    return most_shared(wide[: len(left)], wide[len(left) :])


def by_tokens(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The exact intersections of all pairs of sets."""
    sets = [np.frombuffer(x, np.uint64) for x in left + right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column = np.cumsum(often) - 1
    held = often[place]
    owner, column = owner[held], column[place[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[owner[a:b], column[a:b] - k] = 1
        total += there[: len(left)] @ there[len(left) :].T
    return total


def forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Positions of pairs (best first) that join what ``label`` keeps apart: in each round the best pair of every component."""
    label = np.unique(label, return_inverse=True)[1]
    places, out = np.arange(len(i)), []
    while len(places):
        ends = np.stack([label[i[places]], label[j[places]]], axis=1)
        live = ends[:, 0] != ends[:, 1]
        places, ends = places[live], ends[live]
        if not len(places):
            break
        root = np.arange(label.max() + 1)

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for p in np.unique(np.unique(ends.ravel(), return_index=True)[1] // 2):
            a, b = find(ends[p, 0]), find(ends[p, 1])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append(places[p])
        label = np.array([find(v) for v in range(len(root))])[label]
    return np.array(out, np.int64)


GROUP = ["rep", "band", "one", "two"]


def joined_in_groups(rows: DataFrame, shared: Callable, flags: bool, percent: int) -> DataFrame:
    """(a, b): pairs that can be linked and join components of a group; with ``flags`` also (item, null) for items of any such pair.

    ``rows`` has the columns of ``GROUP``, side (0 for chunk one, 1 for chunk two), own (false for guests), item, size,
    component and content.  A chunk meets itself where one = two.
    """

    def pairs(t: dict[str, np.ndarray], contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(t["side"] == 0)
        second = first if t["one"][0] == t["two"][0] else np.flatnonzero(t["side"] == 1)
        found = []
        # guests are compared with owners only; apart, so that owners keep the full width of their sketches
        for a, b in ((first[t["own"][first]], second[t["own"][second]]), (first[~t["own"][first]], second[t["own"][second]]), (first[t["own"][first]], second[~t["own"][second]])):
            if not len(a) or not len(b):
                continue
            both = shared([contents[k] for k in a], [contents[k] for k in b]).astype(np.float64)
            total = t["size"][a][:, None] + t["size"][b][None]
            near = ((100 + percent) * both >= percent * total) & (t["component"][a][:, None] != t["component"][b][None])
            i, j = np.nonzero(near)
            found.append(np.stack([a[i], b[j], both[i, j] / total[i, j]], axis=1))
        if not found:
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        every = np.concatenate(found)
        every = every[np.argsort(-every[:, 2], kind="stable")]
        ends = every[:, :2].astype(np.int64)
        kept = forest(ends[:, 0], ends[:, 1], t["component"])
        return ends[kept], np.unique(ends)

    def group(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        t = {name: table[name].to_numpy() for name in ("one", "two", "side", "own", "item", "size", "component")}
        t["own"] = t["own"].astype(bool)
        ends, touched = pairs(t, table["content"].to_pylist())
        a, b = t["item"][ends[:, 0]], t["item"][ends[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not flags:
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])
        touched = np.unique(t["item"][touched])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([low, touched])), pa.concat_arrays([pa.array(high), pa.nulls(len(touched), pa.int64())])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(len(GROUP))], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if current is not None and (key[a] != current).any():
                    yield group(held)
                    held = []
                current = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield group(held)

    rows = rows.select(*GROUP, "side", "own", "item", "size", "component", "content")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "item", "side").mapInArrow(run, "a long, b long")


def dealt(inc: DataFrame, info: DataFrame, joined: DataFrame | None) -> DataFrame:
    """The rows of ``joined_in_groups``, from (rep, item), (item, size, content) and (item, component), of groups that are not one component."""
    sizes = info.select(F.col("item").alias("of"), "size")
    if joined is None:
        sizes = sizes.withColumn("component", F.col("of"))
    else:
        known = joined.select(F.col("item").alias("known"), F.col("component").alias("own_component"))
        sizes = sizes.join(known, F.col("of") == F.col("known"), "left").select("of", "size", F.coalesce("own_component", "of").alias("component"))
    band = F.expr("cast(floor(log2(size + 0.5D)) AS int)")
    placed = inc.join(sizes, F.col("item") == F.col("of")).drop("of").withColumn("home", band)
    guest = F.expr("4 * size >= 3 * shiftleft(1L, home + 1)")
    placed = placed.withColumn("band", F.explode(F.when(guest, F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home")))).withColumn("own", F.col("home") == F.col("band")).drop("home")
    split = placed.groupBy(F.col("rep").alias("r"), F.col("band").alias("at")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.max("own").alias("owned"))
    split = split.where("low < high AND owned").select("r", "at", F.expr(f"cast(ceil(n / greatest(16, least(1024, {CHUNK_TOKENS} / power(2, at)))) AS int)").alias("chunks"))
    rows = placed.join(split, (F.col("rep") == F.col("r")) & (F.col("band") == F.col("at"))).drop("r", "at")
    chunk = F.expr("cast(pmod(xxhash64(item), chunks) AS int)")
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other"), "side": F.expr("int(chunk > other)")})
    contents = info.select(F.col("item").alias("of"), "content")
    return rows.join(contents, F.col("item") == F.col("of"))


def passing(items: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test, of fixed size, that all of ``items`` (item: hashes) pass, and few others while they are not many more than its bits."""
    slot, bit = F.expr(f"item & {FILTER_WORDS - 1}L"), F.expr("shiftleft(1L, cast(shiftrightunsigned(item, 40) & 63 AS int))")
    table = items.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[table["slot"].to_numpy()] = table["bits"].to_numpy()
    shared = items.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def test(hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        word = shared.value[(h & U64(FILTER_WORDS - 1)).astype(np.int64)]
        return (word >> ((h >> U64(40)) & U64(63))) & U64(1) > 0

    return test


def resolve(inc: DataFrame, info: DataFrame, sets_of: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(item, component) of linked items that are not the smallest of their component, from ``incidences`` and (item, size, content: the sketch).

    ``sets_of`` gets distinct items (item) and returns (item, content: sorted tokens); ``verify`` gets pairs (a, b) and those
    sets and returns the pairs that are linked.
    """
    links = scratch.spark.createDataFrame([], "a long, b long")
    joined = sets = None
    for turn in (0, 1):
        found = scratch.keep(joined_in_groups(dealt(inc, info, joined), by_sketches, True, percent), f"found_{turn}")
        pairs = found.where("b IS NOT NULL").distinct()
        touched = scratch.keep(found.where("b IS NULL").select(F.col("a").alias("item")).distinct(), f"touched_{turn}")
        if turn == 0:
            sets = scratch.keep(sets_of(touched), "sets")
        good = scratch.keep(verify(pairs, sets), f"links_{turn}")
        tried, linked = pairs.count(), good.count()
        if linked:
            links = links.unionAll(good)
            joined = components(links, scratch, f"joined_{turn}")
        if tried == linked:
            break
        inc = inc.join(touched, "item", "left_semi")
    else:
        sizes = info.select("item", "size").join(sets, "item").join(touched, "item", "left_semi")
        last = scratch.keep(joined_in_groups(dealt(inc, sizes, joined), by_tokens, False, percent), "links_2")
        if not last.isEmpty():
            joined = components(links.unionAll(last), scratch, "joined_2")
    return joined if joined is not None else scratch.spark.createDataFrame([], "item long, component long")
