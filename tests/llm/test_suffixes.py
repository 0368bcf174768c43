"""Repeated strings by suffix sorting against windows in a dictionary."""

import hashlib
import random

import numpy as np
import pytest

from nubes.llm import queries, suffixes

DATA = "/root/testdata/sf0.001"


def brute(docs):
    """(doc_id, kept, spans) of rows in order: every window of 100 bytes is looked up among those before it."""
    seen, out = set(), []
    rank = lambda r: (r[0] is None, r[0] or 0)
    for doc_id, text in sorted(docs, key=rank):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.frombuffer(bytes(gone), np.uint8).astype(int), prepend=0, append=0))
        out.append((doc_id, bytes(c for c, g in zip(raw, gone) if not g), [tuple(x) for x in edges.reshape(-1, 2).tolist()]))
    return sorted(out, key=lambda r: (rank(r), r[1:]))


def found(spark, docs):
    rows = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in rows), key=lambda r: ((r[0] is None, r[0] or 0), r[1:]))


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(n) for n in (14, 20, 30, 60, 200)]
    docs = [(i, " ".join(rng.choice(shared) if rng.random() < 0.4 else say(rng.randint(1, 30)) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    return docs + [(100, docs[3][1]), (101, docs[3][1][7:]), (102, docs[5][1] * 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_all_windows(spark, seed):
    docs = passages(seed)
    assert found(spark, docs) == brute(docs)


def test_open_anchors_and_small_packs(spark, monkeypatch):
    """An anchor whose contexts are sorted in several parts: one line of 60 bytes in texts that differ around it."""
    rng = random.Random(5)
    line = "all rights reserved by the holders of the marks shown below, "
    around = ["".join(rng.choice("xyz") for _ in range(60)) for _ in range(9)]
    docs = [(i, rng.choice(around) + line + rng.choice(around)) for i in range(120)]
    want = brute(docs)
    for name, value in (("GROUP", 3), ("PACK", 50), ("SLAB", 2000), ("PIECE", 150)):
        monkeypatch.setattr(suffixes, name, value)
    rows = [(0, 0, t) for t in (d[1] for d in docs)]
    # the kernels one by one, as the workers don't see patched sizes
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([0] * len(rows)), pa.array([d[1] for d in docs])], ["o", "key", "text"])
    packed = list(suffixes.packs(4)([batch]))
    flat = pa.Table.from_batches(list(suffixes.unpacked(packed))).sort_by([(c, "ascending") for c in ("h", "c", "o", "key", "at")])
    first = pa.Table.from_batches(list(suffixes.first_copies(flat.to_batches(max_chunksize=7))))
    assert max(first["salt"].to_pylist()) > 1
    texts = dict(docs)
    runs = [(r["o"], r["at"], r["b"]) for r in first.to_pylist() if not r["m"]]
    cut = [{**r, "raw": texts[r["o"]].encode()[r["at"] : r["at"] + r["m"] + 99]} for r in first.to_pylist() if r["m"]]
    cut = pa.Table.from_pylist(cut).drop(["b"]).sort_by([("h", "ascending"), ("salt", "ascending")])
    cut = cut.set_column(1, "salt", cut["salt"].cast(pa.int32()))
    slabs = pa.Table.from_batches(list(suffixes.sorted_slabs(4)(cut.to_batches(max_chunksize=5))))
    runs += [(r["o"], r["a"], r["b"]) for r in slabs.to_pylist() if r["part"] is None]
    opened = slabs.filter(slabs["part"].is_valid()).select(["part", "n", "hashes", "rest"])
    strings = pa.Table.from_batches(list(suffixes.unpacked(opened.to_batches()))).sort_by([(c, "ascending") for c in ("h", "c", "o", "key", "at")])
    later = pa.Table.from_batches(list(suffixes.later_copies(strings.to_batches(max_chunksize=9)))).to_pylist()
    assert later
    runs += [(r["o"], r["at"], r["b"]) for r in later]
    gone = {i: set() for i in texts}
    for o, a, b in runs:
        gone[o].update(range(a, b))
    assert {i: sum(e - s for s, e in spans) for i, _, spans in want} == {i: len(g) for i, g in gone.items()}
    assert found(spark, docs) == want


def test_edges(spark):
    text = "".join(random.Random(9).choices("abcdefgh", k=230))
    docs = [
        (1, None), (2, ""), (3, "short"), (3, "short"), (4, "a" * 99), (5, "a" * 100), (6, "a" * 101), (7, "ab" * 300), (8, text), (8, text), (8, text + "!"),
        (None, text), (None, text), (9, "\x00" * 150), (10, "\n" * 120), (11, "é" * 120), (12, text[:100]), (13, text[1:100]),
    ]
    rows = found(spark, docs)
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert [r[1:] for r in by[1] + by[2]] == [(b"", []), (b"", [])]
    assert [r[1] for r in by[3]] == [b"short", b"short"]
    assert by[4][0][2] == by[5][0][2] == []
    assert by[6][0][2] == [(0, 101)]
    assert by[7][0][2] == [(2, 600)]
    assert sorted(len(r[1]) for r in by[8]) in ([0, 0, 231], [0, 1, 230])
    assert [r[1] for r in by[None]] == [b"", b""]
    assert by[9][0][2] == [(1, 150)] and by[10][0][2] == [(1, 120)] and by[11][0][2] == [(2, 240)]
    assert by[12][0][1] == b"" and by[13][0][2] == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).count() == 0


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = {
        i: (len(kept) + sum(e - s for s, e in spans), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, kept, spans in brute(docs)
    }
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_suffix_dedup(spark, DATA).collect()}
    assert got == want
