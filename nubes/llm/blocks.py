"""Vectorised word arithmetic on Arrow text columns.

A ``Block`` views the texts of a slice of an Arrow batch as one byte buffer and finds words, lines and their hashes with
array operations, so operators spend no Python step per word.  Slices hold about a megabyte of text (or one longer text),
which bounds a worker's memory whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
#: Bytes that one polynomial hash covers at most.
RUN = 32
#: What Spark hands a Python worker at once, long texts or short.
BATCH_BYTES = "8m"

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U64 = np.uint64
_BYTE_CODE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and extended between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, SLICE_BYTES + 4096), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def bound_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches of this session by bytes; by rows alone, ten thousand long texts would be one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def plain(column: pa.Array, kind: pa.DataType = pa.string()) -> pa.Array:
    """Nulls become empty texts; other string layouts become the 32-bit one."""
    if column.type != kind:
        column = column.cast(kind)
    return column.fill_null("" if kind == pa.string() else b"") if column.null_count else column


def slices(batch: pa.RecordBatch, name: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about ``size`` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    at = text_offsets(plain(batch.column(batch.schema.get_field_index(name))))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def running(codes: np.ndarray) -> np.ndarray:
    """Sums of codes times powers, from which ``spans`` takes the hash of any span."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(_BASE, len(codes))[: len(codes)], out=sums[1:])
    return sums


def inverse_powers(n: int) -> np.ndarray:
    """What the difference of two sums of ``running`` at ``start`` is multiplied by, for starts up to ``n``."""
    return _power(_INVERSE, n)


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = _power(_INVERSE, len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Words of the texts in one column.

    ``starts``/``ends`` are byte positions in ``data``; text ``d`` has the words ``words[d]`` up to ``words[d + 1]``.
    A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Null texts have no words.  Words are found when asked for.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = plain(column)
        self.n = len(column)
        at = text_offsets(column)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.at = at - at[0]
        self._sums: np.ndarray | None = None

    @cached_property
    def solid(self) -> np.ndarray:
        return ~WHITE[self.data]

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        solid = self.solid
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(solid):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            edges = self.at[(self.at > 0) & (self.at < len(solid))]
            before[edges] = False
            after[edges - 1] = False
        return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def ends(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def words(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.at)

    def word_counts(self) -> np.ndarray:
        return np.diff(self.words)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand.

        Polynomials modulo 2**64 of long strings collide by construction (Thue-Morse), so they cover ``RUN`` bytes at most; a longer
        span is the sum of its runs' hashes, each mixed with its place.
        """
        if self._sums is None:
            self._sums = running(_BYTE_CODE[self.data])
        length = ends - starts
        out = spans(self._sums, starts, np.minimum(ends, starts + RUN))
        long = np.flatnonzero(length > RUN)
        if len(long):
            runs = -(-length[long] // RUN)
            first = np.cumsum(runs) - runs
            place = np.arange(runs.sum()) - np.repeat(first, runs)
            begin = np.repeat(starts[long], runs) + RUN * place
            each = spans(self._sums, begin, np.minimum(begin + RUN, np.repeat(ends[long], runs)))
            sums = np.add.reduceat(mix(each ^ mix(place.astype(np.uint64) + U64(1))), first)
            out[long] = mix(sums + length[long].astype(np.uint64))
        return out

    def word_hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.word_counts())

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without the newline) and text number of every \\n-split line; a text has at least one line."""
        cuts = np.flatnonzero(self.data == 10)
        text = np.searchsorted(self.at, cuts, "right") - 1
        starts = np.concatenate([self.at[:-1], cuts + 1])
        owner = np.concatenate([np.arange(self.n), text])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.empty_like(starts)
        if len(starts):
            last = np.append(owner[1:] != owner[:-1], True)
            ends[:-1] = starts[1:] - 1
            ends[last] = self.at[owner[last] + 1]
        return starts, ends, owner


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that stay between two bounds, and the window count of each group.

    The order is that of the words; windows over a bound are left out.
    """
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    n = len(hashes) - k + 1
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * U64(0xD6E8FEB86659FD93) + hashes[i : n + i]
    inside = np.zeros(len(hashes) + 1, np.int64)
    full = counts > 0
    np.add.at(inside, bounds[:-1][full], 1)
    np.add.at(inside, (bounds[:-1] + counts)[full], -1)
    return mix(acc[np.cumsum(inside[:n]) > 0]), counts


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; quicker than numpy.unique on the short arrays that texts give."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(block: Block, bounds: np.ndarray, k: int, hashes: np.ndarray | None = None) -> list[np.ndarray]:
    """For each group of words the sorted distinct hashes of its k-word shingles; with fewer words the sequence as one."""
    hashes = block.word_hashes() if hashes is None else hashes
    grams, counts = windows(hashes, bounds, k)
    sizes, cut = np.diff(bounds), np.concatenate([[0], np.cumsum(counts)])
    out = []
    for g in range(len(sizes)):
        if counts[g]:
            out.append(distinct(grams[cut[g] : cut[g + 1]]))
        elif sizes[g]:
            acc = U64(0)
            with np.errstate(over="ignore"):
                for h in hashes[bounds[g] : bounds[g + 1]]:
                    acc = acc * U64(0xD6E8FEB86659FD93) + h
            out.append(mix(np.array([acc + U64(int(sizes[g]) * 0x632BE5AB)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column with one array per row."""
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def map_blocks(df: DataFrame, text: str, fn: Callable, schema: str) -> DataFrame:
    """``fn(slice) -> dict of arrays, or None`` over every slice of the texts; column names are those of ``schema``."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)
