"""Quality rules: fixed counts per text, then a log-likelihood ratio of hashed n-grams.

The corpus and a trusted part of it are two multinomials over hashed word unigrams and bigrams.  A text's score is the mean
over its n-grams of log p(trusted) - log p(corpus), and a text stays when the score reaches a threshold.  Weights are
integers (2**-20 steps), so a score does not depend on the order of summation, and reruns agree.

The threshold follows a fixed rule from the scores of all labelled texts that pass the base rule (``best_cut``): the share of
quality 1 lost plus the share of quality 0 kept is least there; of equally good thresholds it is the middle one.

The corpus counts cover every text.  The trusted part is fitted on labelled texts: those labelled quality 1 and nowhere 0,
not toxic, up to ``MAX_TRUSTED`` of them taken by the hash of their id.  Only these ids and the two count tables
(``BUCKETS`` long) go through the driver; both have fixed bounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.llm.blocks import Block, bound_batches, map_blocks, mix, U64, windows
from nubes.plans.scratch import Scratch

BUCKETS = 1 << 16
MAX_TRUSTED = 100_000
#: Mean log ratio per n-gram (natural log) from which on a text stays where labels of both kinds are missing.
THRESHOLD = -0.5
#: Thresholds are multiples of 1 / STEPS.
STEPS = 1 << 10
SCALE = 1 << 20
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def hashed_ngrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every unigram and bigram of a block and the text each stands in."""
    words = block.word_hashes()
    pairs, counts = windows(words, block.words, 2)
    texts = np.concatenate([block.text_of_word(), np.repeat(np.arange(block.n), counts)])
    return (np.concatenate([mix(words ^ U64(0x51)), pairs]) & U64(BUCKETS - 1)).astype(np.int64), texts


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> np.ndarray:
    """Sorted ids of trusted texts, at most ``most``.  Null ids and null labels are not trusted."""
    rows = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("worst"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.count("quality").alias("n"))
        .where("n > 0 AND worst = 1 AND toxic = 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .select("doc_id")
    )
    return np.sort(np.array([r[0] for r in rows.collect()], np.int64))


def count_ngrams(docs: DataFrame, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all texts and over the trusted ones."""
    bound_batches(docs.sparkSession)
    ids = docs.sparkSession.sparkContext.broadcast(trusted)

    def run(batches):
        from nubes.llm.blocks import slices

        every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column(1))
                buckets, texts = hashed_ngrams(block)
                keys = part.column(0)
                known = np.isin(np.asarray(keys.fill_null(0)), ids.value) & np.asarray(keys.is_valid())
                every += np.bincount(buckets, minlength=BUCKETS)
                good += np.bincount(buckets[known[texts]], minlength=BUCKETS)
        seen = np.flatnonzero(every)
        yield pa.RecordBatch.from_pydict({"bucket": seen, "every": every[seen], "good": good[seen]})

    totals = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(run, "bucket long, every long, good long")
        .groupBy("bucket")
        .agg(F.sum("every").alias("every"), F.sum("good").alias("good"))
        .toArrow()
    )
    every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = np.asarray(totals["bucket"])
    every[at], good[at] = np.asarray(totals["every"]), np.asarray(totals["good"])
    return every, good


def log_ratio(every: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Integer weights round(2**20 * (log p(trusted) - log p(corpus))), add-one smoothed; all 0 without trusted texts."""
    if not good.sum():
        return np.zeros(len(every), np.int64)
    ratio = np.log((good + 1) / (good.sum() + len(good))) - np.log((every + 1) / (every.sum() + len(every)))
    return np.rint(SCALE * ratio).astype(np.int64)


def base_counts(block: Block) -> dict[str, np.ndarray]:
    words = block.word_counts()
    starts, ends, owner = block.lines()
    filled = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    line_keys = mix(block.span_hash(starts, ends)[filled] ^ mix((owner[filled] + 1).astype(np.uint64)))
    owner = owner[filled]
    dup_lines = np.bincount(owner, minlength=block.n) - np.bincount(owner[np.unique(line_keys, return_index=True)[1]], minlength=block.n)

    hashes = block.word_hashes()
    grams, counts = windows(hashes, block.words, 3)
    text = np.repeat(np.arange(block.n), counts)
    keys = mix(grams ^ mix((text + 1).astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    at = np.arange(len(keys)) - first[text] + block.words[:-1][text]
    covered = np.zeros(len(hashes) + 2, bool)
    for i in range(3):
        covered[at[twice] + i] = True
    total = np.concatenate([[0], np.cumsum(covered[: len(hashes)])])
    return {
        "n_words": words,
        "word_chars": block.per_text(block.solid & ((block.data & 0xC0) != 0x80)),
        "n_symbols": block.per_text(SYMBOLS[block.data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": total[block.words[1:]] - total[block.words[:-1]],
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double"
)


def best_cut(slots: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold from counts of texts labelled 1 and 0 by slot, floor(score * STEPS)."""
    if not good.sum() or not bad.sum():
        return THRESHOLD
    low = int(slots.min())
    n = int(slots.max()) - low + 2
    kept = [np.bincount(slots - low, weights=w, minlength=n)[::-1].cumsum()[::-1] for w in (good, bad)]
    error = np.rint((good.sum() - kept[0]) * bad.sum() + kept[1] * good.sum())  # whole numbers: ties are exact
    first = int(error.argmin())
    last = first + int(np.argmax(np.append(error[first:], -1) != error[first])) - 1
    return (low + (first + last + 1) // 2) / STEPS


def threshold_of(scores: DataFrame, labels: DataFrame) -> float:
    """The threshold from ``scores`` (doc_id, base_failed, score).  Labels that disagree count as the lower one."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    rows = scores.where("NOT base_failed").select("doc_id", F.floor(F.col("score") * STEPS).alias("slot")).join(known, F.col("doc_id") == F.col("labelled"))
    rows = rows.groupBy("slot").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).toArrow()
    return best_cut(*(np.asarray(rows[c], np.int64) for c in ("slot", "good", "bad")))


def scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Callable]:
    """Counts, ``base_failed`` and ``score`` of every row, and the function that gives the last two for a block."""
    weights = docs.sparkSession.sparkContext.broadcast(log_ratio(*count_ngrams(docs, trusted_ids(labels))))

    def score(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        out = base_counts(block)
        buckets, texts = hashed_ngrams(block)
        total = np.zeros(block.n, np.int64)
        np.add.at(total, texts, weights.value[buckets])
        grams = np.bincount(texts, minlength=block.n)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
        return out, failed, total / (SCALE * np.maximum(grams, 1))

    def run(part):
        out, failed, scores = score(Block(part.column(1)))
        return {"doc_id": part.column(0), **out, "base_failed": failed, "score": scores}

    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run, SCHEMA), score


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``base_failed``, ``kept`` and ``score``.

    Without a given ``threshold`` the labels give it.  A null text counts as empty: no words, so it fails the base rule.
    Repeated rows each get their row; a null doc_id is kept as null and is never trusted.  Without any trusted text every
    score is 0 and the base rules alone decide.  Other columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    rows = Scratch(docs.sparkSession, "quality").keep(scored(docs, labels)[0], "scores")
    least = threshold_of(rows, labels) if threshold is None else threshold
    kept = (~F.col("base_failed") & (F.col("score") >= least)).alias("kept")
    return rows.select(*[c for c in rows.columns if c != "score"], kept, "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, from one more pass over their texts."""
    rows, score = scored(docs, labels)
    least = threshold_of(rows, labels)

    def run(batches):
        from nubes.llm.blocks import slices

        for batch in batches:
            for part in slices(batch, "text"):
                _, failed, scores = score(Block(part.column(part.schema.get_field_index("text"))))
                yield part.filter(pa.array(~failed & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)
