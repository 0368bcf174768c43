"""Nearest neighbours by adaptive dimension scans over inverted lists.

Vectors are normalised and rotated by one random orthogonal matrix, so that the first dimensions of a difference stand for
all of it.  A list's vectors lie in chunks of at most ``CHUNK`` vectors, stored in column blocks.  For a query and a chunk, the
scan adds up squared differences block by block; after t of d dimensions a candidate is abandoned when
``sum * d / t > limit * (1 + EPSILON / sqrt(t))**2``, a test of the hypothesis that its distance is within the limit, the
distance of the worst neighbour found so far.  What survives all blocks is scored exactly on the original vectors.

Centroids, and how many lists a query probes, are fitted on ``SAMPLE`` vectors at most, taken by the hash of their id; the
number of probes is the smallest that reaches ``AIM`` on that sample.  Every vector is indexed.  A query that finds fewer
than k neighbours in its lists is searched again over all lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubes.llm.blocks import bound_batches
from nubes.plans.scratch import Scratch

SAMPLE = 20_000
MAX_LISTS = 1024
CHUNK = 4096
QUERIES = 256
BLOCK = 16
EPSILON = 2.1
AIM = 0.97
SLACK = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: an id, and a vector without nulls, not all zero, all finite.

    Where vectors differ in length, those of the most frequent length take part (the longest, if tied).
    """
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("embedding")).where("vec_id IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (top[0] if top else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit(sample: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rotation, centroids and number of probes from unit vectors; ``n`` is how many vectors the index will hold."""
    rng = np.random.default_rng(7)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))[0]
    x = sample @ rotation
    lists = 1 if n <= 1000 else min(MAX_LISTS, int(n**0.5), max(1, len(x) // 16))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(10):
        near = (x @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=lists)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    near = (x @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)
    tried = rng.choice(len(x), min(len(x), 500), replace=False)
    similar = x[tried] @ x.T
    similar[np.arange(len(tried)), tried] = -np.inf
    best = np.argpartition(-similar, min(k, len(x) - 1), axis=1)[:, :k] if len(x) > k else np.zeros((0, k), int)
    order = np.argsort(((centroids**2).sum(axis=1) / 2 - x[tried] @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)
    ranks = np.sort(place[np.arange(len(best))[:, None], near[best]].ravel()) if len(best) else np.zeros(1, int)
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(AIM * len(ranks))))]) + 1
    return rotation, centroids, probes


def packed(rows: DataFrame, size: int, columns: tuple[str, str]) -> DataFrame:
    """list, ids, vectors (binaries): consecutive rows (list, id, vector) of a partition, ``size`` at most in a row."""

    def run(batches):
        held: list[tuple] = []
        current = None

        def flush():
            ids, vectors = np.array([h[0] for h in held], np.int64), b"".join(h[1] for h in held)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors], pa.binary())], ["list", *columns])

        for batch in batches:
            for key, i, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (key != current or len(held) == size):
                    yield flush()
                    held = []
                current = key
                held.append((i, vector))
        if held:
            yield flush()

    return rows.mapInArrow(run, f"list int, {columns[0]} binary, {columns[1]} binary")


def scan(queries: np.ndarray, blocks: list[np.ndarray], norms: list[np.ndarray], limits: np.ndarray, k: int) -> list[np.ndarray]:
    """For each rotated unit query, the places in a chunk that survive the scan.

    ``blocks`` are the columns of the chunk's rotated unit vectors, ``norms`` their squared norms by block.  ``limits`` are
    squared distances from the queries, lowered here by the first candidates of the chunk.
    """
    n, d = len(blocks[0]), sum(b.shape[1] for b in blocks)
    at = np.cumsum([0] + [b.shape[1] for b in blocks])
    parts = [queries[:, x:y] for x, y in zip(at, at[1:])]
    own = [(p * p).sum(axis=1) for p in parts]
    head = min(n, 8 * k)
    if n > head:
        first = sum(norms[b][:head][None] + own[b][:, None] - 2 * parts[b] @ blocks[b][:head].T for b in range(len(blocks)))
        limits = np.minimum(limits, np.partition(first, k - 1, axis=1)[:, k - 1])
    sums = norms[0][None] + own[0][:, None] - 2 * parts[0] @ blocks[0].T
    alive = sums * (d / at[1]) <= limits[:, None] * (1 + EPSILON / at[1] ** 0.5) ** 2 + SLACK
    out = []
    for q in range(len(queries)):
        left = np.flatnonzero(alive[q])
        total = sums[q, left]
        for b in range(1, len(blocks)):
            if not len(left):
                break
            total = total + norms[b][left] + own[b][q] - 2 * blocks[b][left] @ parts[b][q]
            t = at[b + 1]
            factor = (1 + EPSILON / t**0.5) ** 2 if t < d else 1.0
            keep = total * (d / t) <= limits[q] * factor + SLACK
            left, total = left[keep], total[keep]
        out.append(left)
    return out


def search(queries: DataFrame, chunks: DataFrame, rotation: np.ndarray, k: int, kind: type = np.float32) -> DataFrame:
    """query_id, vec_id, score: for each query (list, query_ids, query_vectors) the k best of each chunk of its list, or fewer.

    Vectors are stored as ``kind``, the type of their table.
    """
    dim = len(rotation)
    shared = queries.sparkSession.sparkContext.broadcast(rotation)

    def run(batches):
        rotation = shared.value
        last, chunk = None, None
        best: dict[int, list[float]] = {}
        current = None
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py()
                if key != current:
                    best, current = {}, key
                qid = np.frombuffer(batch.column(1)[row].as_buffer(), np.int64)
                raw_q = np.frombuffer(batch.column(2)[row].as_buffer(), kind).reshape(-1, dim).astype(np.float64)
                ids = np.frombuffer(batch.column(3)[row].as_buffer(), np.int64)
                mark = (key, ids.tobytes())
                if mark != last:
                    raw = np.frombuffer(batch.column(4)[row].as_buffer(), kind).reshape(-1, dim).astype(np.float64)
                    turned = unit(raw) @ rotation
                    blocks = [np.ascontiguousarray(turned[:, i : i + BLOCK]) for i in range(0, dim, BLOCK)]
                    norms = [(b * b).sum(axis=1) for b in blocks]
                    lengths = np.sqrt((raw * raw).sum(axis=1))
                    last, chunk = mark, (raw, blocks, norms, lengths)
                raw, blocks, norms, lengths = chunk
                # the k-th best score so far bounds the squared distance; one more for the query itself
                limits = np.array([2 - 2 * best[q][-1] if len(best.get(q, ())) > k else np.inf for q in qid.tolist()])
                out_q, out_v, out_s = [], [], []
                for i, places in enumerate(scan(unit(raw_q) @ rotation, blocks, norms, limits, k + 1)):
                    places = places[ids[places] != qid[i]]
                    if len(places):
                        score = (raw[places] * raw_q[i]).sum(axis=1) / (lengths[places] * np.sqrt((raw_q[i] * raw_q[i]).sum()))
                        order = np.lexsort((ids[places], -score))[:k]
                        out_q.append(np.full(len(order), qid[i]))
                        out_v.append(ids[places][order])
                        out_s.append(score[order])
                        q = int(qid[i])
                        best[q] = sorted([*best.get(q, ()), *score[order].tolist()], reverse=True)[: k + 1]
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    pairs = queries.join(chunks, "list").select("list", "query_ids", "query_vectors", "ids", "vectors")
    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a pair counts once.  A query has at most k rows from each chunk that it met."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall_log: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for every query, by cosine, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding; a query's own id is no candidate.  Vectors that are null, zero or
    hold nulls or non-finite numbers take no part, nor do rows without an id.  Rows that share an id count once, with the
    better score.  With k candidates or fewer a query gets them all; without candidates it has no row.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "ann")
    base = usable(vectors)
    kind = np.float32 if base.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    n = base.count()
    head = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    rotation, centroids, probes = fit(unit(matrix(head["embedding"].combine_chunks())), n, k)
    lists, dim = len(centroids), len(rotation)
    shared = spark.sparkContext.broadcast((rotation, centroids, (centroids**2).sum(axis=1) / 2))

    def dealt(many: int):
        def run(batches):
            rotation, centroids, half = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    x = matrix(part.column(1))
                    far = half - (unit(x) @ rotation) @ centroids.T
                    near = far.argmin(axis=1)[:, None] if many == 1 else np.tile(np.arange(lists), (len(x), 1)) if many >= lists else np.argpartition(far, many - 1, axis=1)[:, :many]
                    row = np.repeat(np.arange(len(x)), near.shape[1])
                    blobs = [v.tobytes() for v in x.astype(kind)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(near.ravel().astype(np.int32)), part.column(0).take(pa.array(row)), pa.array([blobs[i] for i in row], pa.binary())], ["list", "id", "vector"]
                    )

        return run

    def gathered(rows: DataFrame, many: int, size: int, salts: int, columns: tuple[str, str]) -> DataFrame:
        # a list can hold a third of all vectors: its rows go to as many partitions as it has chunks on average
        spread = rows.mapInArrow(dealt(many), "list int, id long, vector binary")
        spread = spread.repartition(max(1, min(lists * salts, spark.sparkContext.defaultParallelism * 4)), "list", F.pmod(F.xxhash64("id"), F.lit(salts)))
        return packed(spread.sortWithinPartitions("list", "id"), size, columns)

    salts = max(1, n // (lists * CHUNK))
    chunks = scratch.keep(gathered(base, 1, CHUNK, salts, ("ids", "vectors")), "chunks")
    asked = usable(queries) if queries is not vectors else base
    asked = asked.where(F.size("embedding") == dim).withColumn("embedding", F.col("embedding").cast(base.schema["embedding"].dataType))
    first = gathered(asked, min(probes, lists), QUERIES, 1, ("query_ids", "query_vectors"))
    found = scratch.keep(top(search(first, chunks, rotation, k, kind), k), "found")
    short = asked.select("vec_id").distinct().join(found.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left").where(f"coalesce(count, 0) < {min(k, n - 1)}").select("vec_id")
    short = scratch.keep(short, "short")
    if probes < lists and not short.isEmpty():
        again = gathered(asked.join(short, "vec_id", "left_semi"), lists, QUERIES, 1, ("query_ids", "query_vectors"))
        found = top(found.drop("rank").unionByName(search(again, chunks, rotation, k, kind)), k)
    if recall_log is not None:
        recall_log.append((lists, probes))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
