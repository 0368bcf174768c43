"""Paragraph deduplication by MinHash banding, with passages inside longer paragraphs.

Units of a text are

* paragraphs: lines of ``LEAST_WORDS`` words or more.  ``BANDS`` bands of ``ROWS`` minima over the 5-word shingles make two of
  Jaccard similarity 0.75 meet with probability 1 - (1 - 0.75**2)**10 > 0.9997.  Those that meet are verified by the exact
  similarity of their shingle sets, and linked ones form components.
* passages: every text, lines of any length included, is also cut into pieces at the ends of sentences of ``PIECE_WORDS`` words
  or more (``CUT_OVER`` words without an end are cut after words whose hash says so).  Where a cut stands follows from the words
  before it alone, so a passage that repeats inside other text has the same pieces there but for its ends.  Pieces are one component
  where all their words are equal; a passage is a run of consecutive repeated pieces of ``LEAST_RUN`` words or more.

Of a component's occurrences the first stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubes.llm.blocks import as_signed, Block, bound_batches, lists, mix, shingle_sets, slices, U64, windows
from nubes.llm.groups import incidences, passing, resolve, sketch
from nubes.llm.jaccard import verified
from nubes.llm.repeats import line_block
from nubes.plans.scratch import Scratch

WORDS = 5
LEAST_WORDS = 30
BANDS, ROWS = 10, 2
PIECE_WORDS = 8
CUT_OVER = 40
LEAST_RUN = 24
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | U64(1)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def band_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys for each group of consecutive shingle hashes (no group may be empty), one row a group."""
    if not len(counts):
        return np.zeros((0, BANDS), np.uint64)
    cuts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros((len(counts), BANDS), np.uint64)
    for i, factor in enumerate(_FACTORS):
        out[:, i // ROWS] = mix(out[:, i // ROWS] + np.minimum.reduceat(grams * factor, cuts) + U64(i + 1))
    return out


def pieces(block: Block, line_ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word (exclusive) and hash of every piece of the texts of a block; ``line_ends`` are bytes."""
    n = len(block.starts)
    if not n:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    end = _ENDS[block.data[block.ends - 1]]
    end[np.searchsorted(block.starts, line_ends[line_ends > block.starts[0]]) - 1] = True
    stops = np.flatnonzero(end) + 1
    length = np.diff(stops, prepend=0)
    cut = np.zeros(n + 1, bool)
    cut[stops[length >= PIECE_WORDS]] = True
    endless = np.repeat(length > CUT_OVER, length)
    cut[1:][: len(endless)] |= endless & (hashes[: len(endless)] & U64(15) == 0)
    cut[block.words] = True
    at = np.flatnonzero(cut)
    first, last = at[:-1], at[1:]
    place = np.arange(n) - np.repeat(first, last - first)
    sums = np.add.reduceat(mix(hashes ^ mix(place.astype(np.uint64) + U64(0x51ED))), first)
    return first, last, as_signed(mix(sums + (last - first).astype(np.uint64)))


def _lines(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every line, and whether it is a paragraph."""
    first, last = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
    return first, last, last - first >= LEAST_WORDS


def unit_rows(docs: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, kind (0 paragraph, 1 piece), no (of the line or piece in its text), item, size (words), keys of every unit, pieces only with ``passages``.

    Pieces have no keys; equal paragraphs of a slice carry keys once.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                block, starts, ends, owner, no = line_block(part.column(1))
                hashes = block.word_hashes()
                first, last, long = _lines(block, starts, ends)
                begin, stop, own = pieces(block, ends, hashes) if passages else [np.zeros(0, np.int64)] * 3
                text = np.searchsorted(block.words, begin, "right") - 1
                number = np.arange(len(begin)) - np.searchsorted(text, text)
                starts, ends, owner, no, first, last = (x[long] for x in (starts, ends, owner, no, first, last))
                items = as_signed(block.span_hash(starts, ends))
                once = np.sort(np.unique(items, return_index=True)[1])
                # windows() wants consecutive groups: words between the chosen paragraphs form groups that are skipped
                bounds = np.stack([first[once], last[once]], axis=1).ravel()
                grams, counts = windows(hashes, bounds, WORDS) if len(bounds) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                inside = np.arange(len(counts)) % 2 == 0
                keys = as_signed(band_keys(grams[np.repeat(inside, counts)], counts[inside]))
                each: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(items) + len(begin))
                for at, row in zip(once.tolist(), keys):
                    each[at] = row
                kind = np.repeat([0, 1], [len(items), len(begin)]).astype(np.int32)
                columns = [np.concatenate(x) for x in ((no, number), (items, own), (last - first, stop - begin))]
                ids = part.column(0).take(pa.array(np.concatenate([owner, text])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(kind), *map(pa.array, columns), lists(each, pa.int64())], ["doc_id", "kind", "no", "item", "size", "keys"])

    return docs.mapInArrow(run, "doc_id long, kind int, no long, item long, size long, keys array<long>")


def paragraph_sets(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item, content (binary, sorted 64-bit shingle hashes) of the paragraphs that ``items`` (item) names, and of few others."""
    wanted = passing(items)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                block, starts, ends, _, _ = line_block(part.column(0))
                first, last, long = _lines(block, starts, ends)
                starts, ends, first, last = (x[long] for x in (starts, ends, first, last))
                own = as_signed(block.span_hash(starts, ends))
                own, at = np.unique(own, return_index=True)
                found = wanted(own)
                own, at = own[found], np.sort(at[found])
                own = as_signed(block.span_hash(starts[at], ends[at]))
                sets = shingle_sets(block, np.stack([first[at], last[at]], axis=1).ravel(), WORDS)[::2] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([s.tobytes() for s in sets], pa.binary())], ["item", "content"])

    return docs.select("text").mapInArrow(run, "item long, content binary").groupBy("item").agg(F.first("content").alias("content"))


def sketches(sets: DataFrame) -> DataFrame:
    """item, size (tokens), content (the sketch) of sets (item, content)."""

    def run(batches):
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in tokens], pa.int64()), pa.array([sketch(t) for t in tokens], pa.binary())], ["item", "size", "content"])

    return sets.mapInArrow(run, "item long, size long, content binary")


def repeated_units(rows: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, kind, no, item, size, component, keeper (doc_id, no) of every unit whose component has another one.

    Most pieces occur once.  Only their items are shuffled to be counted; a filter of fixed size then lets the units of repeated
    components pass, and few others, before anything wider is grouped or joined.
    """
    columns = ["doc_id", "kind", "no", "item", "size"]
    root = joined.select(F.col("item").alias("of"), "component")
    whole = rows.where("kind = 0").join(root, F.col("item") == F.col("of"), "left").select(*columns, F.coalesce("component", "item").alias("component"))
    every = whole.unionAll(rows.where("kind = 1").select(*columns, F.col("item").alias("component")))
    wanted = passing(every.groupBy(F.col("component").alias("item")).count().where("count > 1").select("item"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column(5).to_numpy())))

    some = scratch.keep(every.mapInArrow(run, every.schema), "repeated")
    first = some.groupBy(F.col("component").alias("c")).agg(F.min(F.struct("doc_id", "no")).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return some.join(first, F.col("component") == F.col("c")).select(*columns, "component", "keeper")


def repeated_paragraphs(docs: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, kind (0 paragraph, 1 piece of a passage), no, item, component, keeper (doc_id, no) of every unit that has a copy or near copy.

    Passages are looked for with ``passages`` only.  Null and empty texts and rows with a null doc_id take no part; texts of any length are read whole; copies within one document
    count; of ties the smallest (doc_id, no) is the keeper; an empty table gives an empty result; other columns are not read.
    Rows that share a doc_id count as one document, and equal places in both as two occurrences.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "paragraphs")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    rows = scratch.keep(unit_rows(docs, passages), "rows")
    inc = incidences(rows.where("size(keys) > 0").select(F.explode("keys").alias("key"), "item"), scratch, "incidences")
    sets = scratch.keep(paragraph_sets(docs, inc.select("item").distinct()), "candidates")
    info = scratch.keep(sketches(sets), "sketches")
    joined = scratch.keep(resolve(inc, info, lambda items: sets.join(items, "item", "left_semi"), verified, scratch), "components")
    groups = scratch.keep(repeated_units(rows, joined, scratch), "groups")
    scratch.drop_all_but("groups")
    # runs of consecutive pieces of one document
    in_text = Window.partitionBy("doc_id")
    runs = groups.where("kind = 1").withColumn("run", F.col("no") - F.dense_rank().over(in_text.orderBy("no")))
    runs = runs.withColumn("words", F.sum("size").over(Window.partitionBy("doc_id", "run"))).where(F.col("words") >= LEAST_RUN)
    columns = ["doc_id", "kind", "no", "item", "component", "keeper"]
    return groups.where("kind = 0").select(*columns).unionAll(runs.select(*columns))


def dedup_paragraphs(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` with later copies and near copies of paragraphs and passages cut out of ``text``, and ``n_removed``, the units cut.

    Lines that lose all their words go with their line end.  A unit goes only where number and content agree, so rows that share
    an id but not a text lose nothing by mistake.  A null text stays null; rows with a null doc_id, and other columns, stay as
    they are; an empty table gives an empty result.
    """
    later = repeated_paragraphs(docs, passages).where("struct(doc_id, no) <> keeper")
    gone = later.groupBy(F.col("doc_id").alias("__gone_from")).agg(F.collect_set(F.struct("kind", "no", "item")).alias("__gone"))
    docs = docs.drop("n_removed")
    rows = docs.join(gone, F.col("doc_id") == F.col("__gone_from"), "left").drop("__gone_from")
    schema = rows.drop("__gone").schema.add("n_removed", "long")

    def left(text: str, gone: list[dict]) -> tuple[str, int]:
        block, starts, ends, _, _ = line_block(pa.array([text]))
        hashes = block.word_hashes()
        first, last, _ = _lines(block, starts, ends)
        begin, stop, own = pieces(block, ends, hashes)
        lines = as_signed(block.span_hash(starts, ends))
        cut = np.zeros(len(block.starts), bool)
        count = 0
        for g in gone:
            of, a, b = (lines, first, last) if g["kind"] == 0 else (own, begin, stop)
            if g["no"] < len(of) and of[g["no"]] == g["item"]:
                cut[a[g["no"]] : b[g["no"]]] = True
                count += 1
        if not count:
            return text, 0
        data, out = text.encode(), []
        for x, y, a, b in zip(starts, ends, first, last):
            if a < b and cut[a:b].all():
                continue
            kept, at = [], x
            for w in range(a, b):  # a word takes the white space before it along
                if cut[w]:
                    kept.append(data[at : block.ends[w - 1] if w > a else x])
                    at = block.ends[w]
            out.append(b"".join(kept) + data[at:y])
        return b"\n".join(out).decode(), count

    def run(batches):
        for batch in batches:
            at, by = batch.schema.get_field_index("text"), batch.schema.get_field_index("__gone")
            for part in slices(batch, "text"):
                texts, counts = part.column(at).to_pylist(), np.zeros(part.num_rows, np.int64)
                for i, gone in enumerate(part.column(by).to_pylist()):
                    if gone and texts[i] is not None:
                        texts[i], counts[i] = left(texts[i], gone)
                kept = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(part.columns) if k != by]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts)], schema.names)

    return rows.mapInArrow(run, schema)
