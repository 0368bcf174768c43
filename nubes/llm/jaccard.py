"""N-gram Jaccard join with token-combination prefixes.

A text's set holds the 64-bit hashes of its distinct 5-word shingles.  Texts with equal sets are one class from the start.
Classes are joined by prefixes under one global order of tokens: rare ones by hash, then frequent ones from less to more
frequent.  A set of n tokens that is linked to another misses at most t = n - ceil(0.75 n) of its own tokens there, so

* if the first t + 1 tokens are rare, the other set has one of them, and each is a key of its own;
* otherwise all rare tokens are keys, and the prefix is extended into the frequent ones.  These are dealt into g groups by
  hash, and pairs of tokens of one group are keys: with c_j tokens of group j in the prefix, a set that shares no rare token
  and no pair misses r + sum(c_j - 1) tokens, and the prefix ends only when that exceeds t.

g follows the size band (powers of two), so pairs grow in proportion to n; a set near the end of its band also has keys for
the next band.  The set whose prefix ends first in the order shares its tokens within the other's prefix, so no link is lost,
whatever the table of frequent tokens says.  That table (at most ``FREQUENT`` tokens, mergeable counters over every text)
decides only how selective the keys are, and its bound is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.llm.blocks import as_signed, Block, bound_batches, mix, shingle_sets, slices, U64
from nubes.llm.groups import incidences, passing, resolve, sketch
from nubes.plans.scratch import Scratch

WORDS = 5
FREQUENT = 1 << 17
#: A token counts as frequent from so many sets on.
FREQUENT_FROM = 32


def counted(tokens: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of equal tokens, then only counters above the (most + 1)-th largest, less that one (mergeable summaries)."""
    order = np.argsort(tokens)
    tokens, times = tokens[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
    times = np.add.reduceat(times, first) if len(first) else times
    tokens = tokens[first]
    if len(tokens) > most:
        less = np.partition(times, len(times) - most - 1)[len(times) - most - 1]
        tokens, times = tokens[times > less], times[times > less] - less
    return tokens, times


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number that equal sets share and other sets do not."""
    return as_signed(mix(np.array([mix(s ^ U64(0xA5A5A5A5)).sum(dtype=np.uint64) + U64(len(s)) for s in sets], np.uint64)))


def first_pass(docs: DataFrame) -> DataFrame:
    """Per text doc_id, n, item (its set's fingerprint) and sketch (once a task and set); besides, per task, counters (token, times) with a null n."""

    def run(batches):
        seen, held_t, held_c, held = set(), [], [], 0
        none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
        names = ["doc_id", "n", "item", "sketch", "token", "times"]

        def summed() -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([*held_t, *(x for x, _ in held_c)]), np.concatenate([np.ones(held, np.int64), *(y for _, y in held_c)]), FREQUENT)

        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column(1), lower=True)
                sets = shingle_sets(block, block.words, WORDS)
                items, sketches = fingerprints(sets), []
                for s, f in zip(sets, items.tolist()):
                    new = len(s) and f not in seen
                    sketches.append(sketch(s) if new else None)
                    if new:
                        seen.add(f)
                        held_t.append(s)
                        held += len(s)
                k = len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(items), pa.array(sketches, pa.binary()), none(k), none(k)], names)
                if held > 1 << 20:
                    held_t, held_c, held = [], [summed()], 0
        if held or held_c:
            t, c = summed()
            t, c = t[c > 1], c[c > 1]
            k = len(t)
            yield pa.RecordBatch.from_arrays([none(k), none(k), none(k), none(k, pa.binary()), pa.array(as_signed(t)), pa.array(c)], names)

    return docs.mapInArrow(run, "doc_id long, n long, item long, sketch binary, token long, times long")


def keys_of(s: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The join keys of a sorted set.  ``frequent`` is sorted; ``place`` is each one's position in the global order."""
    n = len(s)
    if n < 2:
        return np.zeros(0, np.uint64)  # one token: linked to equal sets only, which are one class
    misses = n - (3 * n + 3) // 4
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        is_frequent = frequent[at] == s
        rare = s[~is_frequent]
    else:
        rare = s
    if len(rare) > misses:
        return mix(rare[: misses + 1] ^ U64(0x1))
    at = at[is_frequent]
    often = frequent[at][np.argsort(place[at])]
    out = [mix(rare ^ U64(0x1))]
    band = n.bit_length() - 1
    for b in (band, band + 1):
        if b > band and 2 * n < 3 << band:
            break
        groups = max(1, (1 << b) // 8)
        group = (mix(often ^ U64(0x7)) % U64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        again = np.ones(len(often), np.int64)  # 0 where a token is its group's first
        again[order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]] = 0
        end = int(np.searchsorted(len(rare) + np.cumsum(again), misses + 1)) + 1
        tokens, group = often[:end], group[:end]
        order = np.argsort(group, kind="stable")
        tokens, group = tokens[order], group[order]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for x, y in zip(cuts, cuts[1:]):
            if y - x > 1:
                own = np.sort(tokens[x:y])
                i, j = np.triu_indices(len(own), 1)
                out.append(mix(mix(own[i]) * U64(3) + own[j] + U64(b)))
    return np.concatenate(out)


def join_keys(docs: DataFrame, frequent: np.ndarray, place: np.ndarray) -> DataFrame:
    """key, item, size of texts with two tokens or more; equal sets of a task appear once."""
    table = docs.sparkSession.sparkContext.broadcast((frequent, place))

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column(1), lower=True)
                sets = shingle_sets(block, block.words, WORDS)
                rows = []
                for s, f in zip(sets, fingerprints(sets).tolist()):
                    if len(s) > 1 and f not in seen:
                        seen.add(f)
                        rows.append((f, len(s), keys_of(s, *table.value)))
                if rows:
                    items, sizes, keys = zip(*rows)
                    each = [len(k) for k in keys]
                    columns = [as_signed(np.concatenate(keys)), np.repeat(np.array(items, np.int64), each), np.repeat(np.array(sizes, np.int32), each)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "item", "size"])

    return docs.mapInArrow(run, "key long, item long, size int")


def token_sets(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item, content (binary, sorted 64-bit hashes) of the sets that ``items`` (item) names, and of few others."""
    wanted = passing(items)

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column(1), lower=True)
                sets = shingle_sets(block, block.words, WORDS)
                rows = []
                fp = fingerprints(sets)
                for s, f, take in zip(sets, fp.tolist(), wanted(fp).tolist()):
                    if take and f not in seen:
                        seen.add(f)
                        rows.append((f, s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary()))], ["item", "content"])

    return docs.mapInArrow(run, "item long, content binary").groupBy("item").agg(F.first("content").alias("content"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or 100 * len(x) < percent * len(y):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    one = sets.toDF("a", "tokens_a")
    two = sets.toDF("b", "tokens_b")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Null texts and texts without words have the empty set, link with nothing and are their own component; texts of fewer
    than five words have their whole sequence as the one shingle.  Texts of any length are read whole.  Repeated rows of one
    text are linked.  A row with a null doc_id is linked to nothing and has a null component.  Other columns are not read; an
    empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id IS NOT NULL")
    first = scratch.keep(first_pass(docs), "first")
    top = (
        first.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
        .where(F.col("times") >= FREQUENT_FROM).orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
    )
    frequent = np.asarray(top["token"]).astype(np.int64).view(np.uint64)[::-1]
    order = np.argsort(frequent)
    texts = first.where("n IS NOT NULL").select("doc_id", "n", "item", "sketch")
    linked = F.expr("n > 0 AND doc_id IS NOT NULL")
    classes = texts.where(linked).groupBy("item").agg(F.min("doc_id").alias("root"), F.first("n").alias("size"), F.first("sketch", ignorenulls=True).alias("content"))
    classes = scratch.keep(classes, "classes")
    inc = incidences(join_keys(known, frequent[order], order), scratch, "incidences")
    joined = scratch.keep(resolve(inc, classes.select("item", "size", "content"), lambda items: token_sets(known, items), verified, scratch), "components")
    scratch.drop_all_but("first", "classes", "components")
    own = classes.select("item", "root").join(joined, "item", "left").select("item", "root", F.coalesce("component", "item").alias("component"))
    least = own.groupBy(F.col("component").alias("of")).agg(F.min("root").alias("component_id"))
    roots = own.join(least, F.col("component") == F.col("of")).select(F.col("item").alias("of"), "component_id")
    found = texts.where(linked).join(roots, F.col("item") == F.col("of"), "left")
    alone = texts.where(~linked).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return found.select(*columns).unionAll(alone.select(*columns))
