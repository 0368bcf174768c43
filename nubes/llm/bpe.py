"""Byte-level BPE encoding and decoding by merge replay.

Each task takes its share of the corpus in blocks.  The distinct pieces of a block are laid out as one sequence of byte
tokens, an inverted index maps every mergeable token pair to the positions where it stands, and merges are replayed over the
whole block in rank order: one index entry at a time, over all words at once, touching only the two neighbours of each merged
pair.  Work therefore follows the number of distinct pieces, not of words.  Pieces stay known within a task, up to
``MAX_PIECES`` of them, after which the table starts anew; the bound limits memory and changes no result.

A corpus-wide table of pieces would need every word occurrence joined back to it, a shuffle larger than the corpus; replay
per task shuffles nothing and gives the same ids, since merges never cross a piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.llm.blocks import bound_batches, lists, plain, slices

MAX_PIECES = 250_000
#: A block ends when so many new pieces or words have gathered.
BLOCK_PIECES = 100_000
BLOCK_WORDS = 3_000_000


class Ranks:
    """A rank file: token bytes by id, and the rank of every token pair whose joined bytes are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)])
        self.first = np.full((256, 256), -1, np.int64)
        pairs: dict[int, int] = {}
        for t, r in self.rank.items():
            if len(t) == 2:
                self.first[t[0], t[1]] = r
            for k in range(1, len(t)):
                x = self.rank.get(t[:k])
                if x is not None and (y := self.rank.get(t[k:])) is not None:
                    pairs[x << 24 | y] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        #: Tokens that join a neighbour at a rank below their own.
        self.early = {t for k, r in pairs.items() for t in (k >> 24, k & 0xFFFFFF) if r < t}

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where they don't join; token -1 joins with nothing."""
        keys = a << 24 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.found[at], -1)


def replay(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Token ids of each word (not empty), all words merged together in rank order."""
    data = np.frombuffer(b"".join(words), np.uint8)
    if not len(data):
        return [[] for _ in words]
    ends = np.cumsum([len(w) for w in words])
    n = len(data)
    # place n stands for "no neighbour"; pair[i] is the rank of token i with the one to its right
    token = np.append(ranks.byte[data], -1)
    right = np.arange(1, n + 2)
    right[ends - 1] = right[n] = n
    left = np.arange(-1, n)
    left[ends[:-1]] = left[0] = left[n] = n
    pair = np.concatenate([ranks.first[data[:-1], data[1:]], [-1, -1]])
    pair[ends - 1] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(places: np.ndarray) -> None:
        """Enters places under the rank of their pair."""
        of = pair[places]
        places, of = places[of >= 0], of[of >= 0]
        order = np.argsort(of, kind="stable")
        places, of = places[order], of[order]
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
        for x, y, r in zip(cuts, cuts[1:], of[cuts[:-1]].tolist()):
            have = index.get(r)
            if have is None:
                index[r] = [places[x:y]]
                heapq.heappush(heap, r)
            else:
                have.append(places[x:y])

    note(np.flatnonzero(pair[:n] >= 0))
    while heap:
        rank = heapq.heappop(heap)
        entry = index.pop(rank)
        at = np.unique(np.concatenate(entry)) if len(entry) > 1 else entry[0]
        at = at[pair[at] == rank]
        if not len(at):
            continue
        if rank in ranks.early:
            # a pair of lower rank may come up in a word and goes first: one merge a word, then the others again
            word = np.searchsorted(ends, at, "right")
            first = np.append(True, word[1:] != word[:-1])
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(heap, rank)
                at = at[first]
        elif len(at) > 1:
            # of places that overlap, each with the next, every other one merges, from the left
            apart = np.append(True, right[at[:-1]] != at[1:])
            if not apart.all():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 0]
        gone = right[at]
        after = right[gone]
        token[at] = rank
        token[gone] = pair[gone] = -1
        right[at] = after
        left[after] = at
        touched = np.concatenate([at, left[at]])
        pair[touched] = ranks.of_pairs(token[touched], token[right[touched]])
        pair[n] = -1
        note(touched)
    alive = np.flatnonzero(token[:n] >= 0)
    flat = token[alive].tolist()
    bounds = np.searchsorted(alive, ends).tolist()
    return [flat[a:b] for a, b in zip([0, *bounds[:-1]], bounds)]


#: Texts without characters from here on are split by the standard library's matcher with classes spelled out.
LATIN_END = 0x250


def splitter(pattern: str):
    """findall for a pattern in the ``regex`` library's syntax; the same matches, sooner, on Latin texts."""
    import re

    import regex

    def ranges(name: str) -> str:
        inside = [bool(regex.match(name, chr(c))) for c in range(LATIN_END)] + [False]
        out, start = [], None
        for c, is_in in enumerate(inside):
            if is_in and start is None:
                start = c
            elif not is_in and start is not None:
                out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
                start = None
        return "".join(out)

    every = regex.compile(pattern).findall
    spelled = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\p{L}", ranges(r"\p{L}")).replace(r"\p{N}", ranges(r"\p{N}")).replace(r"\s", ranges(r"\s")), pattern)
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        spelled = spelled.replace(name, f"[{ranges(name)}]")
    if "\\p" in spelled:
        return every
    spelled = spelled.replace(r"\S", f"[^{ranges(chr(92) + 's')}]")
    latin, other = re.compile(spelled).findall, re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search
    return lambda text: every(text) if other(text) else latin(text)


class _Pieces(dict):
    """Piece -> number; a new piece gets the next number and waits for its ids."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.waiting.append(piece)
        self[piece] = number = len(self)
        return number


class Encoder:
    """Numbers the pieces of texts; ``replay`` then gives the ids, decimal form and decoded bytes of all new pieces."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.split = ranks, splitter(pattern)
        self.clear()

    def clear(self) -> None:
        self.pieces, self.ids, self.names, self.bytes = _Pieces(), [], [], []

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        number = self.pieces.__getitem__
        return [np.fromiter(map(number, self.split(t)), np.int32) for t in texts]

    def replay(self) -> None:
        new = [p.encode() for p in self.pieces.waiting]
        self.pieces.waiting = []
        known = [self.ranks.rank.get(p) for p in new]
        replayed = iter(replay([p for p, k in zip(new, known) if k is None], self.ranks))
        token = self.ranks.token
        for k in known:
            ids = next(replayed) if k is None else [k]
            self.ids.append(ids)
            self.names.append(",".join(map(str, ids)))
            self.bytes.append(b"".join([token[i] for i in ids]))

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.Array, list[np.ndarray]]]]:
        """(doc_id column, piece numbers of each text) of slices of (doc_id, text), once their pieces have ids."""
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append((part.column(0), self.numbered(plain(part.column(1)).to_pylist())))
                size += sum(map(len, held[-1][1]))
                if len(self.pieces.waiting) > BLOCK_PIECES or size > BLOCK_WORDS:
                    self.replay()
                    yield held
                    held, size = [], 0
                    if len(self.pieces) > MAX_PIECES:
                        self.clear()
        self.replay()
        yield held


def encode(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array<int>) of every row, as the tiktoken library's encode_ordinary gives them.

    Each match of ``pattern`` is encoded by itself; special tokens are ordinary text.  Null and empty texts give an empty
    array; repeated rows each get their row; null ids stay null; other columns are not read.  ``ranks_path`` must be readable
    where tasks run, as an installed package is.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Ranks(ranks_path), pattern)
        for held in encoder.blocks(batches):
            ids = encoder.ids
            for key, rows in held:
                flat = [np.array([i for n in doc.tolist() for i in ids[n]], np.int32) for doc in rows]
                yield pa.RecordBatch.from_arrays([key, lists(flat, pa.int32())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and ``bytes`` (binary): the joined bytes of the tokens.  Null arrays decode to empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = None
        for batch in batches:
            token = token or Ranks(ranks_path).token.__getitem__
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [b"".join(map(token, ids or ())) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every row, ids decoded again.

    Ids and decoded bytes are kept by piece, so both digests are fed from pieces and no array of ids leaves the task.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Ranks(ranks_path), pattern)
        for held in encoder.blocks(batches):
            name, decoded = encoder.names.__getitem__, encoder.bytes.__getitem__
            sizes = np.fromiter(map(len, encoder.ids), np.int64)
            for key, rows in held:
                rows = [x.tolist() for x in rows]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": key,
                        "n_tokens": pa.array([int(sizes[x].sum()) for x in rows], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(",".join(map(name, x)).encode()).hexdigest() for x in rows], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(b"".join(map(decoded, x))).hexdigest() for x in rows], pa.string()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
