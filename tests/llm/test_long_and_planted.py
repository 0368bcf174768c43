"""Passages inside long lines, very long texts, hashes of long spans, archives by bytes, and the bounds of the group resolver."""

import itertools
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nubes.llm import ann, blocks, groups, paragraphs, pii, warc
from test_operators import changed, docs_frame, edit_distance, prose


def sentences(seed, n):
    """n sentences of 9 to 14 words."""
    rng = np.random.default_rng(seed)
    return [" ".join(f"{'abcdefgh'[seed % 8]}{v}" for v in rng.integers(0, 5000, rng.integers(9, 15))) + "." for _ in range(n)]


def test_a_passage_inside_long_lines_is_found_and_cut(spark):
    passage = " ".join(sentences(1, 6))  # 60 words or so
    assert len(passage.split()) > 50
    around = [" ".join(sentences(s, 12)) for s in range(2, 7)]
    texts = [f"{around[0]} and so {passage} {around[1]}", f"{around[2]} then {passage} {around[3]}", around[4], None, "", passage.replace(". ", ".\n", 2)]
    rows = paragraphs.repeated_paragraphs(docs_frame(spark, texts), passages=True).collect()
    assert {r.doc_id for r in rows} == {0, 1, 5}
    out = {r.doc_id: r for r in paragraphs.dedup_paragraphs(docs_frame(spark, texts), passages=True).collect()}
    assert out[0].text == texts[0] and out[2].text == texts[2] and out[3].text is None and out[4].text == ""
    # the first sentence of the passage stands in one piece with the words before it
    rest = passage.split(". ", 1)[1]
    assert rest[:60] not in out[1].text and all(s in out[1].text for s in (around[2], around[3][-40:])) and out[1].n_removed >= 4
    assert rest[:60].split(".")[0] not in out[5].text
    assert paragraphs.repeated_paragraphs(docs_frame(spark, texts).limit(0), passages=True).collect() == []


def test_pieces_are_those_of_a_plain_reading():
    rng = np.random.default_rng(3)
    for _ in range(40):
        text = "".join(rng.choice(["a", "bb", "c.", "dd!", "\n", " ", " "], 400))
        block = blocks.Block(pa.array([text, "x. y z", "", text[:50]]))
        _, ends, _ = block.lines()
        first, last, own = paragraphs.pieces(block, ends, block.word_hashes())
        want = []
        for number, t in enumerate([text, "x. y z", "", text[:50]]):
            held, sentence = 0, 0
            for line in t.split("\n"):
                words = line.split()
                for k, w in enumerate(words):
                    held, sentence = held + 1, sentence + 1
                    if w[-1] in ".!?" or k == len(words) - 1:
                        if sentence >= paragraphs.PIECE_WORDS and sentence <= paragraphs.CUT_OVER:
                            want.append(held)
                            held = 0
                        sentence = 0
            if held:
                want.append(held)
        if all(len(s.split()) <= paragraphs.CUT_OVER for s in re.split(r"[.!?]\s|\n", text)):
            assert (last - first).tolist() == want
        words = [block.data[a:b].tobytes() for a, b in zip(block.starts, block.ends)]
        seen = {}
        for a, b, h in zip(first, last, own.tolist()):
            assert seen.setdefault(h, words[a:b]) == words[a:b]


def test_hashes_of_long_spans_tell_thue_morse_words_apart():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word, word[:-1], "x" + word[1:]]
    block = blocks.Block(pa.array(texts))
    h = block.word_hashes().tolist()
    assert h[0] == h[2] and len(set(h)) == 4
    rng = np.random.default_rng(2)
    parts = ["".join(rng.choice(list("abc"), rng.integers(1, 100))) for _ in range(300)] * 2
    block = blocks.Block(pa.array([" ".join(parts)]))
    assert len(set(block.word_hashes().tolist())) == len(set(parts)) and (block.word_hashes()[:300] == block.word_hashes()[300:]).all()


def test_base_spans_equal_the_patterns_and_take_linear_time():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(rng.choice(list("a1.@-+ 0"), rng.integers(0, 40)))
        assert list(pii.emails(text)) == [m.span() for m in pii.EMAIL.finditer(text)]
        assert [m.span() for m in pii.IP_RUNS.finditer(text)] == [m.span() for m in pii.IP.finditer(text)]
    n = 1_000_000
    began = time.time()
    for text in ("a" * n, "1" * n, "0" * n + ".1.1.1", "1." * (n // 2), "a@" * (n // 2), "+1" + "(" * n, "1 " * (n // 2), "a." * (n // 2) + "@b"):
        pii.base_spans(text)
    assert time.time() - began < 20
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]
    assert pii.apart_from([(0, 2, "x"), (3, 5, "x"), (9, 12, "x")], [(1, 2, "e"), (1, 9, "p"), (4, 5, "i")]) == [(9, 12, "x")]
    for _ in range(300):
        old = sorted((int(a), int(a + b), "e") for a, b in rng.integers(1, 9, (4, 2)))
        new = [(int(a), int(a + b), "x") for a, b in rng.integers(1, 9, (6, 2))]
        assert pii.apart_from(new, old) == [s for s in new if all(s[1] <= a or b <= s[0] for a, b, _ in old)]


def test_the_field_finds_words_of_templates_it_has_not_seen(spark):
    rows = pii.labelled_sentences(spark)
    template = F.col("sentence") % len(pii.TEMPLATES) % 4
    field = pii.train(rows.where(template != 0))
    held = {}
    for r in rows.where(template == 0).orderBy("sentence", "no").collect():
        held.setdefault(r.sentence, []).append((r.word, r.label))
    texts = [" ".join(w for w, _ in s) for s in held.values()]
    hit = total = wrong = 0
    for s, spans in zip(held.values(), pii.added_spans(field, blocks.Block(pa.array(texts)), texts)):
        at = 0
        for w, label in s:
            found = [k for a, b, k in spans if a <= at < b or at <= a < at + len(w)]
            total += label != "out"
            hit += label != "out" and label in found
            wrong += label == "out" and bool(found)
            at += len(w) + 1
    print("templates apart: recall", hit / total, "words marked wrongly", wrong)
    assert hit / total > 0.6


def test_archives_end_by_bytes_and_long_pages_come_back(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, "u", "".join(rng.choice(list("abcdef \n"), 1_000_000 if i % 2 else 100))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    root = f"file://{tmp_path}/w"
    got = {r.page_id: r for r in warc.page_archive(pages, root).collect()}
    assert len(got) == 60 and all(got[i].payload_bytes == len(h) and got[i].record_type == "response" for i, _, h in rows)
    index = warc.read_index(spark, f"{root}/members")
    sizes = {r.archive: r.n for r in warc.read(spark, f"{root}/members", index).groupBy("archive").agg(F.sum("payload_bytes").alias("n")).collect()}
    assert len(sizes) >= 2 and max(sizes.values()) <= warc.ARCHIVE_BYTES + 2_000_000
    # every record is a member of its own at its place
    assert all(r.offset >= 0 and r.length > 0 for r in index.collect()) and index.count() == 60


def test_bounds_and_counts_of_intersections():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 5, 64, 127, 128, 300, 600, 880) for _ in range(3)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    raw = [s.tobytes() for s in sets]
    assert (groups.by_tokens(raw, raw) == exact).all()
    sketches = [groups.sketch(s) for s in sets]
    for i, j in itertools.product(range(len(sets)), repeat=2):
        assert groups.by_sketches([sketches[i]], [sketches[j]])[0, 0] >= exact[i, j]
    assert (groups.by_sketches(sketches, sketches) >= exact).all()
    # a forest joins what its pairs join, the best ones first
    i, j = rng.integers(0, 40, (2, 100))
    kept = groups.forest(i, j, np.arange(40))
    root = list(range(40))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k in kept:
        a, b = find(i[k]), find(j[k])
        assert a != b
        root[max(a, b)] = min(a, b)
    assert all(find(a) == find(b) for a, b in zip(i, j))


def test_equal_scores_go_to_the_smaller_id_and_doubles_stay_doubles(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    x[3] = x[4] = x[5] = x[0]
    x[7] = 4 * x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in rows][:4] == [3, 4, 5, 7]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(abs(r.score - unit[0] @ unit[r.vec_id]) < 1e-15 * 4 for r in rows)


def test_near_paragraphs_share_a_band():
    missed = 0
    for seed in range(60):
        a = prose(seed, 80, 10_000)
        b = changed(a, [40], seed)
        left, right = (blocks.Block(pa.array([" ".join(w)])) for w in (a, b))
        keys = [paragraphs.band_keys(*blocks.windows(k.word_hashes(), k.words, 5))[0] for k in (left, right)]
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0 and edit_distance("ab", "b") == 1
