"""Repeated 100-byte strings by two-stage suffix sorting.

Which suffixes have to be sorted at all is settled first.  Every window of ``LEAST`` bytes names one anchor inside it, the
32-byte gram with the least hash, so equal windows have equal anchors at equal places.  Consecutive windows with one anchor are
a context.  Contexts are shuffled as hashes, packed by parts of the anchor's hash: a later copy of an equal context is removed
as a whole, an anchor with one context only needs no sorting, and the first copies of all other contexts are cut from their
texts and sorted.

Sorting works on about a megabyte of contexts that share their anchors.  Suffixes smaller than their successor are sorted
directly; the others follow by one scan over the buckets of first bytes, each bucket putting the predecessors of its suffixes,
in order, into theirs.  Neighbours in suffix order with a common prefix of ``LEAST`` bytes are one string; all but its first
start are covered.  Contexts of an anchor beyond ``GROUP`` are sorted in parts, and the strings' first starts of the parts are
then compared by hash, packed like the contexts before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.llm.blocks import _BYTE_CODE, Block, as_signed, bound_batches, mix, plain, running, slices, spans
from nubes.plans.scratch import Scratch

#: Bytes of a string that counts when it repeats.
LEAST = 100
#: Bytes of an anchor; ``blocks.RUN`` at most, so that its hash is one polynomial.
GRAM = 32
#: Bytes of a text looked at in one go; places within take 24 bits.
PIECE = 1 << 23
#: Contexts that a task packs at once, contexts of an anchor sorted together, bytes of contexts sorted together.
PACK = 1 << 19
GROUP = 8192
SLAB = 1 << 20
U64 = np.uint64
I64 = np.int64


# --- contexts of a text


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def contexts(block: Block) -> tuple[np.ndarray, ...]:
    """(h, c, start, windows) of the contexts of a block's texts: hash of the anchor, hash of all bytes that the windows cover,
    place of the first window in the block, and how many windows there are.  Pieces of a long text overlap by a window less a byte."""
    found = []
    n = len(block.data)
    if n < LEAST:
        return tuple(np.zeros(0, t) for t in (U64, U64, I64, I64))
    block.span_hash(np.zeros(1, I64), np.ones(1, I64))  # sets up the running sums
    for begin in range(0, max(1, n - LEAST + 1), PIECE):
        end = min(n, begin + PIECE + LEAST - 1)
        at = np.arange(begin, end - GRAM + 1)
        grams = spans(block._sums, at, at + GRAM)
        marked = (grams >> U64(24) << U64(24)) | (at - begin).astype(U64)
        anchor = (sliding_least(marked, LEAST - GRAM + 1) & U64((1 << 24) - 1)).astype(I64)
        start = np.arange(begin, begin + len(anchor))
        inside = start + LEAST <= block.at[np.searchsorted(block.at, start, "right")]
        start, anchor = start[inside], anchor[inside]
        if not len(start):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(start)))
        low = start[first]
        found.append((grams[anchor[first]], block.span_hash(low, low + windows + LEAST - 1), low, windows))
    if not found:
        return tuple(np.zeros(0, t) for t in (U64, U64, I64, I64))
    return tuple(np.concatenate(x) for x in zip(*found))


def joined_runs(o: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals [a, b) of rows (o, key), those that touch put together."""
    if not len(a):
        return o, key, a, b
    order = np.lexsort((a, key, o))
    o, key, a, b = o[order], key[order], a[order], b[order]
    same = (o[1:] == o[:-1]) & (key[1:] == key[:-1])
    group = np.cumsum(np.concatenate([[0], ~same]))
    # a running maximum of ends inside each row: rows are lifted apart first
    lift = group * (int(b.max()) + 1)
    top = np.maximum.accumulate(b + lift)
    new = np.concatenate([[True], ~same | (a[1:] + lift[1:] > top[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(a) - 1)
    return o[at], key[at], a[at], (top - lift)[last]


def pack(part: int, hashes: list[np.ndarray], rest: list[np.ndarray]) -> tuple:
    small = np.concatenate([np.diff(r, prepend=0) for r in rest]).tobytes()
    return part, len(rest[0]), b"".join(h.tobytes() for h in hashes), pa.compress(small, codec="zstd", asbytes=True)


def packs(parts: int):
    """Rows (o, key, text) to packs of contexts by part of the anchor's hash; of equal contexts of one pack the first alone stays and
    the others are given as intervals (``hashes`` is empty there)."""

    def flush(held: list[tuple]):
        h, c, o, key, at, m = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        near = h[order][1:] == h[order][:-1]
        twin = order[np.concatenate([[False], near]) | np.concatenate([near, [False]])]
        twin = twin[np.lexsort((at[twin], key[twin], o[twin], c[twin], h[twin]))]
        again = twin[1:][(h[twin][1:] == h[twin][:-1]) & (c[twin][1:] == c[twin][:-1])]
        stays = np.ones(len(h), bool)
        stays[again] = False
        out = []
        if len(again):
            runs = joined_runs(o[again], key[again], at[again], at[again] + m[again] + LEAST - 1)
            out += split(part_of(runs[0], parts), [], list(runs))
        h, c, o, key, at, m = (x[stays] for x in (h, c, o, key, at, m))
        return out + split(part_of(h, parts), [h, c], [o, key, at, m])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column(2))
                h, c, low, m = contexts(block)
                if not len(h):
                    continue
                text = np.searchsorted(block.at, low, "right") - 1
                o, key = (part.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
                held.append((h, c, o, key, low - block.at[text], m))
                count += len(h)
                if count >= PACK:
                    yield packed_batch(flush(held))
                    held, count = [], 0
        if held:
            yield packed_batch(flush(held))

    return run


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Anchors have small hashes, being the least of many: they are mixed again before they are dealt."""
    return (mix(h.view(U64)) >> U64(32)) * U64(parts) >> U64(32)


def split(part: np.ndarray, hashes: list[np.ndarray], rest: list[np.ndarray]) -> list[tuple]:
    part = part.astype(I64)
    order = np.lexsort((rest[2], rest[1], rest[0], part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return [pack(int(part[at[0]]), [h[at] for h in hashes], [r[at] for r in rest]) for at in np.split(order, cuts[1:]) if len(at)]


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["part", "n", "hashes", "rest"])


ROW = "h long, c long, o long, key long, at long, m long"


def unpacked(batches):
    """``ROW`` rows of packs; an interval [a, b) has m = 0, a as ``at`` and b as ``c``."""
    for batch in batches:
        for n, hashes, rest in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            kinds = 4
            small = np.frombuffer(pa.decompress(rest, n * kinds * 8, codec="zstd"), I64).reshape(kinds, n).cumsum(axis=1)
            o, key, at, last = small
            if hashes:
                h, c = np.frombuffer(hashes, I64).reshape(2, n)
                m = last
            else:
                h, c, m = o, last, np.zeros(n, I64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, o, key, at, m)], ["h", "c", "o", "key", "at", "m"])


def intervals(o: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """``FIRST`` rows of what is covered."""
    o, key, a, b = joined_runs(o, key, a, b)
    zero = np.zeros(len(o), I64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (zero, zero.astype(np.int32), np.zeros(len(o), bool), o, key, a, zero, b)], NAMES)


def later_copies(batches):
    """From ``ROW`` rows sorted by (h, c, o, key, at) the intervals of all but the first of equal (h, c)."""
    last = None
    for batch in batches:
        if batch.num_rows:
            h, c, o, key, at, m = (batch.column(k).to_numpy() for k in range(6))
            again = np.concatenate([[last == (h[0], c[0])], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
            last = (h[-1], c[-1])
            if again.any():
                yield intervals(o[again], key[again], at[again], at[again] + m[again] + LEAST - 1)


FIRST = "h long, salt int, open boolean, o long, key long, at long, m long, b long"


def first_copies(batches):
    """From ``ROW`` rows sorted by (h, c, o, key, at): intervals of later copies (m = 0), and the first copies of all contexts of
    anchors that have two contexts at least.  ``GROUP`` contexts of an anchor share a salt; anchors with several salts are open."""
    last = None
    pending: list[np.ndarray] = []
    state = {"h": None, "salt": 0}

    def firsts(rows: np.ndarray, salt: np.ndarray, opened: np.ndarray):
        h, o, key, at, m = rows
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, salt.astype(np.int32), opened, o, key, at, m, at + m + LEAST - 1)], NAMES)

    def closed(rows: np.ndarray):
        """Rows of an anchor that ends: nothing where it has one context."""
        many = state["salt"] > 0
        if rows.shape[1] > 1 or many:
            n = rows.shape[1]
            salt = state["salt"] + np.arange(n) // GROUP
            yield firsts(rows, salt, np.full(n, many or n > GROUP))

    for batch in batches:
        h, c, o, key, at, m = (batch.column(k).to_numpy() for k in range(6))
        known = m == 0
        if known.any():
            yield intervals(o[known], key[known], at[known], c[known])
            h, c, o, key, at, m = (x[~known] for x in (h, c, o, key, at, m))
        if not len(h):
            continue
        again = np.concatenate([[last == (h[0], c[0])], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
        last = (h[-1], c[-1])
        if again.any():
            yield intervals(o[again], key[again], at[again], at[again] + m[again] + LEAST - 1)
        rows = np.stack([x[~again] for x in (h, o, key, at, m)])
        if not rows.shape[1]:
            continue
        if pending and rows[0, 0] != state["h"]:
            yield from closed(np.concatenate(pending, axis=1))
            pending, state["salt"] = [], 0
        if pending:
            rows = np.concatenate([*pending, rows], axis=1)
            pending = []
        tail = int(np.searchsorted(rows[0], rows[0, -1]))
        head = rows[:, :tail]
        if tail:
            cut = np.flatnonzero(np.diff(head[0], prepend=head[0, 0] - 1))
            size = np.diff(np.append(cut, tail))
            if state["salt"] and rows[0, 0] == state["h"]:  # the open anchor ends here
                yield from closed(head[:, : size[0]])
                head, cut, size = head[:, size[0] :], cut[1:] - size[0], size[1:]
            state["salt"] = 0
            more = np.repeat(size, size) > 1
            place = np.arange(head.shape[1]) - np.repeat(cut, size)
            if more.any():
                yield firsts(head[:, more], (place // GROUP)[more], (np.repeat(size, size) > GROUP)[more])
        rest = rows[:, tail:]
        state["h"] = rest[0, 0]
        while rest.shape[1] > GROUP:
            yield firsts(rest[:, :GROUP], np.full(GROUP, state["salt"]), np.ones(GROUP, bool))
            rest = rest[:, GROUP:]
            state["salt"] += 1
        pending = [rest]
    if pending:
        yield from closed(np.concatenate(pending, axis=1))


NAMES = ["h", "salt", "open", "o", "key", "at", "m", "b"]


# --- suffix sorting


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one a byte later; the last one is not, for it is longer than the empty suffix."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    step[-1] = -1
    # equal neighbours: the next place where bytes differ decides
    place = np.where(step != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(place[::-1])[::-1]
    return step[ahead] > 0


def suffix_order(data: np.ndarray, depth: int = LEAST) -> np.ndarray:
    """Places of all suffixes in order of their first ``depth`` bytes at least, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly.  Every other suffix is larger than its successor, so a scan of the
    buckets of first bytes in ascending order meets the successor first and appends the suffix to its own bucket in its turn.
    """
    n = len(data)
    if not n:
        return np.zeros(0, I64)
    width = -(-depth // 8) * 8
    direct = np.flatnonzero(smaller_than_next(data))
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    direct = direct[np.argsort(np.ascontiguousarray(view[direct]).view(f"S{width}").ravel(), kind="stable")]
    of = data[direct]
    ends = np.searchsorted(of, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))
    out = []
    for byte in np.unique(data).tolist():
        turn = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, I64)
        own = [turn]
        while len(turn):  # runs of one byte: a longer run is larger
            turn = turn[turn > 0] - 1
            turn = turn[data[turn] == byte]
            own.append(turn)
        bucket = np.concatenate([*own, direct[ends[byte] : ends[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > byte]
        if len(before):
            first = data[before]
            before = before[np.argsort(first, kind="stable")]
            cuts = np.searchsorted(data[before], np.arange(257))
            for larger in np.flatnonzero(np.diff(cuts)):
                induced[larger].append(before[cuts[larger] : cuts[larger + 1]])
    return np.concatenate(out)


def alike(data: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the common prefix of each pair of places has ``LEAST`` bytes, eight bytes at a time; both places have that many."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    left = np.arange(len(one))
    for k in [*range(0, LEAST - 7, 8), LEAST - 8]:
        a, b = (np.ascontiguousarray(words[x[left] + k]).view(U64).ravel() for x in (one, two))
        left = left[a == b]
    out = np.zeros(len(one), bool)
    out[left] = True
    return out


SORTED = "o long, key long, a long, b long, part int, n int, hashes binary, rest binary"


def sort_slab(raw: list[bytes], h: np.ndarray, opened: np.ndarray, o: np.ndarray, key: np.ndarray, at: np.ndarray, m: np.ndarray, parts: int) -> pa.RecordBatch:
    """``SORTED`` rows of some contexts: intervals (part is null), and for open anchors packs of the first start of every string."""
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)  # 0xff is no byte of UTF-8
    begin = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    order = suffix_order(data)
    whose = np.searchsorted(begin, order, "right") - 1
    fits = order - begin[whose] < m[whose]  # starts of windows of the context
    order, whose = order[fits], whose[fits]
    same = alike(data, order[:-1], order[1:])
    string = np.cumsum(np.concatenate([[0], ~same]))
    place = at[whose] + order - begin[whose]
    by = np.lexsort((place, key[whose], o[whose], string))
    first = np.concatenate([[True], string[by][1:] != string[by][:-1]])
    late = by[~first]
    runs = joined_runs(o[whose[late]], key[whose[late]], place[late], place[late] + LEAST)
    lead = by[first]
    lead = lead[opened[whose[lead]]]
    packed = []
    if len(lead):
        block = Block(pa.array([""]))
        block.data, block._sums = data, running(_BYTE_CODE[data])
        prints = block.span_hash(order[lead], order[lead] + LEAST)
        of = whose[lead]
        packed = split(part_of(h[of], parts), [h[of], as_signed(prints)], [o[of], key[of], place[lead], np.ones(len(lead), I64)])
    n, k = len(runs[0]), len(packed)
    part, count, hashes, rest = zip(*packed) if packed else ((), (), (), ())
    padded = lambda x, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(x, kind)])
    cells = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(k, pa.int64())]) for x in runs]
    cells += [padded(part, pa.int32()), padded(count, pa.int32()), padded(hashes, pa.binary()), padded(rest, pa.binary())]
    return pa.RecordBatch.from_arrays(cells, ["o", "key", "a", "b", "part", "n", "hashes", "rest"])


def sorted_slabs(parts: int):
    """A mapInArrow function: rows (h, salt, open, o, key, at, m, raw) ordered by (h, salt), sorted about ``SLAB`` bytes at a time; a salt stays together."""

    def flush(rows: pa.Table):
        h, _, opened, o, key, at, m = (rows.column(k).to_numpy() for k in range(7))
        return sort_slab(rows.column(7).to_pylist(), h, opened, o, key, at, m, parts)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(7).nbytes
            if size < 2 * SLAB:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h, salt = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            cuts = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1  # where a group begins
            ends = np.cumsum(rows.column(6).to_numpy() + LEAST)
            at = 0
            while len(cuts := cuts[cuts > at]):
                reach = np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB)
                if reach >= len(h):
                    break
                fit = cuts[cuts <= reach]
                to = int(fit[-1] if len(fit) else cuts[0])
                yield flush(rows.slice(at, to - at))
                at = to
            held = rows.slice(at).to_batches()
            size = sum(b.column(7).nbytes for b in held)
            if size >= 2 * SLAB and not len(cuts):
                size = 0  # one group so far: wait for its end, which GROUP bounds
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def cut_contexts(batches):
    """Rows (o, key, text, list of contexts) to one row for each context with its bytes."""
    for batch in batches:
        texts = plain(batch.column(2)).cast(pa.binary())
        for i in range(batch.num_rows):
            raw = texts[i].as_py()
            rows = batch.column(3)[i].values
            h, salt, opened, at, m = (rows.field(k) for k in range(5))
            n = len(rows)
            low, many = at.to_numpy(), m.to_numpy()
            for k in range(0, n, GROUP):
                cut = slice(k, k + GROUP)
                bits = [raw[a : a + w + LEAST - 1] for a, w in zip(low[cut].tolist(), many[cut].tolist())]
                j = len(bits)
                own = [pa.array(np.full(j, batch.column(c)[i].as_py(), I64)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [h.slice(k, j), salt.slice(k, j), opened.slice(k, j), *own, at.slice(k, j), m.slice(k, j), pa.array(bits, pa.binary())],
                    ["h", "salt", "open", "o", "key", "at", "m", "raw"],
                )


# --- the operator


KEPT = "doc_id {id}, kept binary, spans array<struct<start:long,end:long>>"


def kept_bytes(batches):
    """Rows (doc_id, text, intervals) to what is left of the text and the runs removed."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = plain(part.column(1)).cast(pa.binary())
            kept, runs = [], []
            for i in range(part.num_rows):
                raw = texts[i].as_py()
                if not part.column(2)[i].is_valid:
                    kept.append(raw)
                    runs.append([])
                    continue
                rows = part.column(2)[i].values
                a, b = rows.field(0).to_numpy(), rows.field(1).to_numpy()
                zero = np.zeros(len(a), I64)
                _, _, a, b = joined_runs(zero, zero, a, b)
                ends = [0, *b.tolist()]
                kept.append(b"".join(raw[x:y] for x, y in zip(ends, [*a.tolist(), len(raw)])))
                runs.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(runs, kind)], ["doc_id", "kept", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes left) and spans (runs removed: start, end in bytes) for every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``LEAST`` bytes over it also starts earlier: in a row with a smaller doc_id, or earlier in the same
    text.  Null texts are empty.  Rows with a null id come after all others; rows that share an id are ordered by a hash of their
    text, and of rows equal in both the first counts as earlier.  Texts under ``LEAST`` bytes stay as they are; long texts are read
    whole, in overlapping pieces.  Matches end at the text's ends.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "suffixes")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    shared = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = docs.select("doc_id", order.alias("o"), (F.xxhash64("text") if shared else F.lit(0).cast("long")).alias("key"), "text")
    copies = None
    if shared:
        many = scratch.keep(rows.groupBy("o", "key").agg(F.count("*").alias("n")).where("n > 1"), "many")
        if not many.isEmpty():
            twice = rows.join(many, ["o", "key"], "left_semi").dropDuplicates(["o", "key"])
            rows = rows.join(many, ["o", "key"], "left_anti").unionByName(twice)
            length = F.octet_length("text")
            gone = length >= LEAST
            copies = twice.join(many, ["o", "key"]).withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).select(
                "doc_id", F.when(gone, F.lit(b"")).otherwise(F.encode("text", "UTF-8")).alias("kept"),
                F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), length.cast("long").alias("end")))).otherwise(F.expr("array()")).alias("spans"),
            )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("o", "key", "text").mapInArrow(packs(4 * width), "part int, n int, hashes binary, rest binary").repartition(width, "part")
    found = dealt.mapInArrow(unpacked, ROW).sortWithinPartitions("h", "c", "o", "key", "at").mapInArrow(first_copies, FIRST)
    found = scratch.keep(found, "found")
    lists = found.where("m > 0").groupBy("o", "key").agg(F.collect_list(F.struct("h", "salt", "open", "at", "m")).alias("contexts"))
    cut = rows.select("o", "key", "text").join(lists, ["o", "key"]).mapInArrow(cut_contexts, "h long, salt int, open boolean, o long, key long, at long, m long, raw binary")
    slabs = cut.repartition(width, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(sorted_slabs(4 * width), SORTED)
    slabs = scratch.keep(slabs, "slabs")
    opened = slabs.where("part IS NOT NULL").select("part", "n", "hashes", "rest").repartition(width, "part").mapInArrow(unpacked, ROW)
    across = opened.sortWithinPartitions("h", "c", "o", "key", "at").mapInArrow(later_copies, FIRST)
    known = [found.where("m = 0").select("o", "key", F.col("at").alias("a"), "b"), slabs.where("part IS NULL").select("o", "key", "a", "b"), across.select("o", "key", F.col("at").alias("a"), "b")]
    runs = known[0].unionAll(known[1]).unionAll(known[2])
    runs = runs.groupBy("o", "key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    left = rows.join(runs, ["o", "key"], "left").select("doc_id", "text", "runs").mapInArrow(kept_bytes, KEPT.format(id=docs.schema["doc_id"].dataType.simpleString()))
    return left if copies is None else left.unionByName(copies)
