"""Hard negatives by rotated one-bit codes with stored alignments.

Vectors become whole numbers v = floor(256 x).  A vector, rotated by one random orthogonal matrix, is described by its length and
by ``LEVELS`` codes: the signs of its components, then the signs of what the first code leaves, and so on; each code comes with
its alignment, the cosine between the code and what it describes.  Packed into words, a code meets an anchor by popcounts
against the bit planes of the anchor, whose components are rounded to ``PLANES`` bits.

The estimate's error is bounded, not guessed: what the codes leave of a vector has a known length and is perpendicular to the last
code, so by Cauchy-Schwarz it changes the product by that length times the anchor's part perpendicular to the code at most; the
anchor's rounding adds its own length times that of the code's part.  A candidate whose interval cannot reach the k best is
left out, level by level; the others are scored on the whole numbers.  Results are therefore those of all pairs.

Chunks of vectors and blocks of anchors meet on a two-dimensional grid of tasks, shaped so that little is copied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubes.llm.blocks import bound_batches
from nubes.plans.scratch import Scratch

SCALE = 256
LEVELS, PLANES = 3, 4
#: Vectors of a chunk, anchors of a block, pairs that a task of the grid looks at, about.
CHUNK, ANCHORS, PAIRS = 8192, 256, 1 << 31
#: Squared length that a vector stays under, so that every score is a long.
SQUARES = 2.0**62
SLACK = 1e-7
I64 = np.int64
_rotations: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """The same orthogonal matrix in every task."""
    if d not in _rotations:
        _rotations[d] = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    return _rotations[d]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v, d of the rows that take part; of rows that share an id the one with the smallest label and vector."""
    whole = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(2.0**31 / SCALE)))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(fine, F.lit(False))).where(F.size("embedding") > 0)
    rows = rows.select("vec_id", "label", whole.alias("v")).where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) < SQUARES)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return rows.withColumn("d", F.size("v"))


def encode(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, alignments, codes) of rotated vectors: n, n x levels, n x levels x words."""
    n, d = y.shape
    words = -(-d // 64)
    length = np.sqrt((y * y).sum(axis=1))
    rest, left = y.copy(), length.copy()
    alignments, codes = np.zeros((n, LEVELS)), np.zeros((n, LEVELS, words), np.uint64)
    for level in range(LEVELS):
        up = rest >= 0
        part = np.abs(rest).sum(axis=1) / np.sqrt(d)
        alignments[:, level] = np.minimum(part / np.maximum(left, 1e-300), 1.0)
        bits = np.zeros((n, words * 64), np.uint8)
        bits[:, :d] = up
        codes[:, level] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        rest -= np.where(up, 1.0, -1.0) * (part / np.sqrt(d))[:, None]
        left = left * np.sqrt(np.maximum(1 - alignments[:, level] ** 2, 0.0))
    return length, alignments, codes


def planes_of(y: np.ndarray) -> tuple[float, float, np.ndarray, float]:
    """(least, step, planes, error) of one rotated anchor: its components are least + step * whole number + what is left, of length ``error``."""
    least, step = float(y.min()), max(float(y.max() - y.min()) / (2**PLANES - 1), 1e-300)
    whole = np.rint((y - least) / step).astype(np.uint8)
    error = float(np.sqrt(((y - least - step * whole) ** 2).sum()))
    bits = np.zeros((PLANES, -(-len(y) // 64) * 64), np.uint8)
    for p in range(PLANES):
        bits[p, : len(y)] = whole >> p & 1
    return least, step, np.packbits(bits, axis=1, bitorder="little").view(np.uint64), error


class Codes:
    """The codes of a chunk's vectors and the intervals that they give for an anchor."""

    def __init__(self, length: np.ndarray, alignments: np.ndarray, codes: np.ndarray, d: int):
        self.length, self.alignments, self.codes, self.d = length, alignments, codes, d
        left = length[:, None] * np.cumprod(np.sqrt(np.maximum(1 - alignments**2, 0.0)), axis=1)
        self.left = left  # what remains after each level
        self.part = np.concatenate([length[:, None], left[:, :-1]], axis=1) * alignments
        self.ones = np.bitwise_count(codes).sum(axis=2, dtype=I64)

    def product(self, level: int, at: np.ndarray, anchor: tuple) -> np.ndarray:
        """Products of the rounded anchor with the unit codes, by popcounts."""
        least, step, planes, _ = anchor
        code = self.codes[at, level]
        both = np.zeros(len(at), I64)
        sums = 0
        for p, plane in enumerate(planes):
            both += np.bitwise_count(code & plane).sum(axis=1, dtype=I64) << p
            sums += int(np.bitwise_count(plane).sum(dtype=I64)) << p
        signs = 2 * self.ones[at, level] - self.d
        return (least * signs + step * (2 * both - sums)) / np.sqrt(self.d)

    def intervals(self, at: np.ndarray, level: int, mid: np.ndarray, wide: np.ndarray, anchor: tuple, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, mid, wide) of the products after one more level; ``mid`` and ``wide`` are those of the levels before."""
        product = self.product(level, at, anchor)
        part = self.part[at, level]
        mid, wide = mid + part * product, wide + part * anchor[3]
        along = np.maximum(np.abs(product) - anchor[3], 0.0)  # the anchor's part along the code is this at least
        rest = self.left[at, level] * np.sqrt(np.maximum(size * size - along * along, 0.0)) + wide + SLACK * size * self.length[at] + SLACK
        return mid - rest, mid + rest, mid, wide


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher scores first, ties to smaller ids."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[-k]
        at = np.flatnonzero(score >= least)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[-k]) if len(values) >= k else -np.inf


def reach(codes: Codes, at: np.ndarray, anchor: tuple, size: float, bands: list[tuple[float, float, int, float]]) -> np.ndarray:
    """The candidates of ``at`` that can be among the k best within any of ``bands`` (low, high, k, least): score bounds, k, and a
    score that k others are known to reach."""
    mid, wide = np.zeros(len(at)), np.zeros(len(at))
    for level in range(LEVELS):
        if not len(at):
            break
        low, high, mid, wide = codes.intervals(at, level, mid, wide, anchor, size)
        keep = np.zeros(len(at), bool)
        for floor, ceiling, k, least in bands:
            sure = low[(low >= floor) & (high <= ceiling)]
            keep |= (high >= max(floor, least, kth(sure, k))) & (low <= ceiling)
        at, mid, wide = at[keep], mid[keep], wide[keep]
    return at


def chunked(batches):
    """Rows (vec_id, label, v) of one length and group, in order of their labels, to chunks with codes."""
    for batch in batches:
        ids, label, d, g = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
        flat = batch.column(2).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(d)])
        cut = np.flatnonzero(np.diff(d, prepend=-1) | np.diff(g, prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(d))):
            for i in range(a, b, CHUNK):
                j = min(i + CHUNK, b)
                v = flat[ends[i] : ends[j]].reshape(j - i, -1)
                order = np.lexsort((ids[i:j], label[i:j]))
                length, alignments, codes = encode(v[order] @ rotation(v.shape[1]).T)
                blobs = [x.tobytes() for x in (ids[i:j][order], label[i:j][order], v[order].astype(np.int32), length, alignments, codes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(d[i])], pa.int32()), pa.array([int(g[i])], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)],
                    ["d", "g", "ids", "labels", "v", "length", "alignments", "codes"],
                )


CHUNKS = "d int, g int, ids binary, labels binary, v binary, length binary, alignments binary, codes binary"


def anchor_blocks(batches):
    """Rows (vec_id, label, v, positives) of one length and block to blocks of ``ANCHORS`` at most."""
    for batch in batches:
        ids, label, d, h = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
        flat = batch.column(2).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(d)])
        cut = np.flatnonzero(np.diff(d, prepend=-1) | np.diff(h, prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(d))):
            for i in range(a, b, ANCHORS):
                j = min(i + ANCHORS, b)
                lists = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(5).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(d[i])], pa.int32()), pa.array([int(h[i])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[i:j], label[i:j], flat[ends[i] : ends[j]].astype(np.int32))), lists],
                    ["d", "h", "a_ids", "a_labels", "a_v", "a_scores"],
                )


BLOCKS = "d int, h int, a_ids binary, a_labels binary, a_v binary, a_scores array<array<struct<id:long,score:long>>>"


def scored(score_rows):
    """A mapInArrow function over met chunks and blocks; ``score_rows(anchor, chunk, known)`` yields (positive, ids, scores)."""

    def run(batches):
        known: dict[tuple, np.ndarray] = {}
        last = chunk = task = None
        for batch in batches:
            at = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                d = at["d"][i].as_py()
                read = lambda name, kind: np.frombuffer(at[name][i].as_buffer(), kind)  # noqa: B023, E731
                mark = (d, at["g"][i].as_py(), at["ids"][i].as_buffer().to_pybytes())
                if mark != last:
                    n = len(read("length", np.float64))
                    codes = Codes(read("length", np.float64), read("alignments", np.float64).reshape(n, LEVELS), read("codes", np.uint64).reshape(n, LEVELS, -1), d)
                    last, chunk = mark, (read("ids", I64), read("labels", I64), read("v", np.int32).reshape(n, d), codes)
                a_ids, a_labels, a_v = read("a_ids", I64), read("a_labels", I64), read("a_v", np.int32).reshape(-1, d).astype(I64)
                if task != mark[:2]:
                    task, known = mark[:2], {}
                turned = a_v @ rotation(d).T
                out = []
                for k in range(len(a_ids)):
                    size = float(np.sqrt((turned[k] * turned[k]).sum()))
                    anchor = (a_ids[k], a_labels[k], a_v[k], planes_of(turned[k]), size, at["a_scores"][i].values[k])
                    out += [(a_ids[k], *row) for row in score_rows(anchor, chunk, known)]
                if out:
                    times = [len(row[2]) for row in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([r[0] for r in out], times)), pa.array(np.repeat([r[1] for r in out], times)), pa.array(np.concatenate([r[2] for r in out])), pa.array(np.concatenate([r[3] for r in out]))],
                        ["anchor_id", "positive_id", "id", "score"],
                    )

    return run


FOUND = "anchor_id long, positive_id long, id long, score long"


def exact(v: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (v[at].astype(I64) * q).sum(axis=1)


def kept_best(known: dict, key: tuple, score: np.ndarray, k: int) -> None:
    """Keeps the k best scores that a task has seen under ``key``."""
    known[key] = np.sort(np.concatenate([known.get(key, np.zeros(0, I64)), score]))[-k:]


def seen(known: dict, key: tuple, k: int) -> float:
    had = known.get(key, ())
    return float(had[0]) if len(had) == k else -np.inf


def positive_rows(k: int):
    def rows(anchor, chunk, known):
        aid, label, q, planes, size, _ = anchor
        ids, labels, v, codes = chunk
        at = np.arange(*np.searchsorted(labels, [label, label + 1]))
        at = at[ids[at] != aid]
        key = (int(aid), 0)
        at = reach(codes, at, planes, size, [(-np.inf, np.inf, k, seen(known, key, k))])
        score = exact(v, at, q)
        top = best(score, ids[at], k)
        kept_best(known, key, score[top], k)
        if len(top):
            yield 0, ids[at[top]], score[top]

    return rows


def negative_rows(k: int, low: int, high: int, base: int):
    def rows(anchor, chunk, known):
        aid, label, q, planes, size, positives = anchor
        ids, labels, v, codes = chunk
        wanted = []
        for p in positives.as_py():
            floor, ceiling = -((-low * p["score"]) // base), high * p["score"] // base
            if floor <= ceiling:
                wanted.append((p["id"], floor, ceiling))
        if not wanted:
            return
        a, b = np.searchsorted(labels, [label, label + 1])
        at = np.concatenate([np.arange(a), np.arange(b, len(labels))])
        at = reach(codes, at, planes, size, [(floor, ceiling, k, seen(known, (int(aid), pid), k)) for pid, floor, ceiling in wanted])
        score = exact(v, at, q)
        for pid, floor, ceiling in wanted:
            inside = np.flatnonzero((score >= floor) & (score <= ceiling))
            top = inside[best(score[inside], ids[at[inside]], k)]
            kept_best(known, (int(aid), pid), score[top], k)
            if len(top):
                yield pid, ids[at[top]], score[top]

    return rows


def grid(n: int, m: int, cores: int) -> tuple[int, int]:
    """Groups of vectors and groups of anchors: enough tasks for ``PAIRS`` each, with few copies: vectors travel once for each group of
    anchors and anchors once for each group of vectors."""
    tasks = max(cores, n * m // PAIRS)
    groups = min(max(1, round((tasks * n / m) ** 0.5)), max(1, n // 1024))
    return groups, max(1, min(-(-tasks // groups), m // 16 or 1))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, base: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its ``positives`` best other rows of the same label, and for each of those the ``negatives`` best rows of other
    labels with ``low * positive_score <= base * negative_score <= high * positive_score``; fewer where there are fewer.  Scores are
    inner products of floor(256 x), higher first, ties to the smaller vec_id.  ``vectors`` and ``anchors`` have vec_id, label and
    embedding; every anchor should also be a row of ``vectors``.

    Rows without an id or label, with a null vector, null or non-finite components, or of a length of 2**31 and more (in whole
    numbers: scores would be no longs) take no part.  Of rows that share an id that with the smallest label and vector counts.
    Vectors meet those of their own length only.  Anchors without a positive, positives with a negative score or without a
    negative, and empty tables give no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "negatives")
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base_rows, asked = usable(vectors), usable(anchors)
    n, m = base_rows.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], names)
    groups, sides = grid(n, m, spark.sparkContext.defaultParallelism)
    number = lambda c, of: F.pmod(F.xxhash64(F.col(c), F.lit(3)), F.lit(of)).cast("int")
    rows = base_rows.withColumn("g", number("vec_id", groups)).repartition(groups, "d", "g").sortWithinPartitions("d", "g", "label", "vec_id")
    chunks = scratch.keep(rows.mapInArrow(chunked, CHUNKS), "chunks")

    def met(asked: DataFrame, kernel) -> DataFrame:
        dealt = asked.withColumn("h", number("vec_id", sides)).select("vec_id", "label", "v", "d", "h", "scores")
        dealt = dealt.repartition(sides, "d", "h").sortWithinPartitions("d", "h").mapInArrow(anchor_blocks, BLOCKS)
        dealt = dealt.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        copies = chunks.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
        both = copies.join(dealt, ["d", "g", "h"]).select("d", "g", "h", "ids", "labels", "v", "length", "alignments", "codes", "a_ids", "a_labels", "a_v", "a_scores")
        return both.mapInArrow(scored(kernel), FOUND)

    def top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.expr("CAST(array() AS array<struct<id:long,score:long>>)")
    first = scratch.keep(top(met(asked.withColumn("scores", none), positive_rows(positives)), ["anchor_id"], positives), "positives")
    lists = first.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("scores")).withColumnRenamed("anchor_id", "vec_id")
    found = met(asked.join(lists, "vec_id"), negative_rows(negatives, low, high, base))
    found = top(found, ["anchor_id", "positive_id"], negatives)
    scores = first.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
