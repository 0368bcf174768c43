"""What line and paragraph deduplication share: occurrences, the later ones of a group, and texts without them.

A line is what ``\\n`` splits.  An occurrence is (doc_id, no): the document and the number of the line in it, from 0.  Lines
with equal content are one item; items are grouped further by links.  Of a group's occurrences the smallest stays.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.llm.blocks import Block, plain, slices
from nubes.llm.groups import passing
from nubes.plans.scratch import Scratch


def grouped(occurrences: DataFrame, joined: DataFrame) -> DataFrame:
    """doc_id, no, item, component, keeper (doc_id, no) of every occurrence whose group has another one."""
    root = joined.select(F.col("item").alias("of"), "component")
    rows = occurrences.select("doc_id", "no", "item").join(root, F.col("item") == F.col("of"), "left")
    rows = rows.select("doc_id", "no", "item", F.coalesce("component", "item").alias("component"))
    # copies of one item can fill a third of the table: counts and firsts are combined before the shuffle
    first = rows.groupBy(F.col("component").alias("c")).agg(F.min(F.struct("doc_id", "no")).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, F.col("component") == F.col("c")).select("doc_id", "no", "item", "component", "keeper")


def removals(groups: DataFrame) -> DataFrame:
    """__gone_from, __gone: per document the (no, item) of occurrences that a smaller one stands for."""
    later = groups.where("struct(doc_id, no) <> keeper")
    return later.groupBy(F.col("doc_id").alias("__gone_from")).agg(F.sort_array(F.collect_list(F.struct("no", "item"))).alias("__gone"))


def line_block(column: pa.Array) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block, its lines' starts, ends, text numbers and numbers within the text."""
    block = Block(column, lower=True)
    starts, ends, owner = block.lines()
    no = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return block, starts, ends, owner, no


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with an added ``n_removed`` and the given lines cut out of ``text``; the other lines keep their order.

    A line goes only where number and content agree, so rows that share an id but not a text lose nothing by mistake.  A column
    ``n_removed`` that ``docs`` has is replaced.
    """
    docs = docs.drop("n_removed")
    rows = docs.join(gone, F.col("doc_id") == F.col("__gone_from"), "left").drop("__gone_from")
    schema = rows.drop("__gone").schema.add("n_removed", "long")

    def run(batches):
        for batch in batches:
            at, by = batch.schema.get_field_index("text"), batch.schema.get_field_index("__gone")
            for part in slices(batch, "text"):
                texts = part.column(at)
                block, starts, ends, owner, no = line_block(texts)
                first = np.searchsorted(owner, np.arange(block.n + 1))
                gone = part.column(by)
                of = np.repeat(np.arange(block.n), gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                number, item = (gone.flatten().field(k).to_numpy() for k in (0, 1))
                there = number < (first[1:] - first[:-1])[of]
                of, line, item = of[there], (first[of] + number)[there], item[there]
                line = line[block.span_hash(starts[line], ends[line]).view(np.int64) == item]
                stays = np.ones(len(starts), bool)
                stays[line] = False
                count = np.bincount(owner[~stays], minlength=block.n)
                out = plain(texts).to_pylist()
                for i in np.flatnonzero(count).tolist():
                    out[i] = "\n".join(compress(out[i].split("\n"), stays[first[i] : first[i + 1]].tolist()))
                kept = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(part.columns) if k != by]
                if texts.null_count:
                    spot = at - (by < at)
                    kept[spot] = pa.array([t if v else None for t, v in zip(out, texts.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*kept, pa.array(count)], schema.names)

    return rows.mapInArrow(run, schema)


def lines_of(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """item, line (binary, A-Z in lower case) of the lines whose item is among ``items`` (item), and of few others."""
    wanted = passing(items)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                block, starts, ends, _, _ = line_block(part.column(0))
                own, at = np.unique(block.span_hash(starts, ends).view(np.int64), return_index=True)
                found = wanted(own)
                own, at = own[found], at[found]
                raw = block.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([raw[starts[i] : ends[i]] for i in at], pa.binary())], ["item", "line"])

    lines = docs.select("text").mapInArrow(run, "item long, line binary")
    return scratch.keep(lines.groupBy("item").agg(F.first("line").alias("line")), "lines")
