"""Each operator against a brute-force twin, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.llm import components as connected
from nubes.llm import ann, blocks, bpe, jaccard, lines, mixing, paragraphs, pii, quality, secrets, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, texts, ids=None):
    """Texts with columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[k], t, "en", f"s{k % 3}" if k % 4 else None, 1, 2, 3) for k, (i, t) in enumerate(zip(range(len(texts)), texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, key long, item long")


def prose(seed, n, vocabulary=400):
    return [f"w{v}" for v in np.random.default_rng(seed).integers(0, vocabulary, n)]


def components(n, links):
    root = list(range(n))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def changed(words, at, seed):
    out = list(words)
    for k, i in enumerate(at):
        out[i] = f"x{seed}_{k}"
    return out


@pytest.fixture(scope="module")
def texts():
    base, other = prose(1, 120), prose(2, 200)
    out = [" ".join(base), " ".join(base).upper(), " ".join(changed(base, [60], 1)), " ".join(changed(base, [10, 50, 90], 2)), " ".join(changed(base, range(0, 120, 7), 3))]
    out += [" ".join(changed(other, range(s, 40, 5), s)) for s in range(12)]
    out += [None, "", " \n\t", "one two", "One  TWO", "a b c d e", "a b c d e f", "\n".join(" ".join(prose(s, 40)) for s in range(5, 9)), " ".join(prose(4, 30_000, 5_000)), " ".join(prose(4, 30_000, 5_000)[:-9])]
    return out


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("frequent", [1 << 17, 0])
def test_jaccard_join_is_that_of_all_pairs(spark, texts, monkeypatch, frequent):
    if not frequent:
        monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3)  # most tokens of the fixture become frequent: pairs of tokens are keys
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, components(len(sets), links)))]
    got = sorted(tuple(r) for r in jaccard.similar_documents(docs_frame(spark, texts)).collect())
    assert got == want


def test_jaccard_join_of_nothing_null_ids_and_repeated_rows(spark):
    assert jaccard.similar_documents(docs_frame(spark, ["a"]).limit(0)).collect() == []
    rows = sorted((tuple(r) for r in jaccard.similar_documents(docs_frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [4, 4, None])).collect()), key=repr)
    assert rows == [(4, 2, 4), (4, 2, 4), (None, 2, None)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_banded_distance_equals_the_table(spark):
    rng = np.random.default_rng(3)
    left, right = [], []
    for _ in range(400):
        a = "".join(rng.choice(list("abé"), rng.integers(0, 12)))
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(0, len(b) + 1)
            if rng.random() < 0.5:
                b.insert(k, "b")
            elif b:
                del b[min(k, len(b) - 1)]
        left.append(a)
        right.append("".join(b))
    got = lines.within([x.encode() for x in left], [x.encode() for x in right])
    assert got.tolist() == [edit_distance(a, b) <= 2 for a, b in zip(left, right)]


def brute_lines(texts):
    rows = [(d, no, re.sub("[A-Z]", lambda m: m[0].lower(), line)) for d, t in enumerate(texts) if t is not None for no, line in enumerate(t.split("\n")) if len(line) >= 30]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if abs(len(rows[i][2]) - len(rows[j][2])) <= 2 and edit_distance(rows[i][2], rows[j][2]) <= 2]
    gone = {rows[i][:2] for i, c in enumerate(components(len(rows), links)) if c != i}
    return [None if t is None else "\n".join(line for no, line in enumerate(t.split("\n")) if (d, no) not in gone) for d, t in enumerate(texts)]


def test_line_dedup_removes_what_all_pairs_remove(spark):
    line = "The quick brown fox jumps over the lazy dog, é"
    near = [line, line.upper(), line.replace("fox", "fax"), line[2:], line + "!!", line.replace("quick", "quock") + "!", line.replace("The quick", "Tha quack") + "ab"]
    many = [line[:20] + "é" * (k % 3) + line[20:] + "z" * k for k in range(8)]
    texts = ["\n".join([near[0], "short", near[1]]), "\n".join(near[2:5]), None, "", "short\nshort", "\n".join(near[5:]), "\n".join(many[:4] + ["own line of this document only, 12345"]), "\n".join(many[4:])]
    out = lines.dedup_lines(docs_frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in out] == brute_lines(texts)
    assert out[0].n == 1 and out[4].n_removed == 0 and out[2].text is None
    assert lines.dedup_lines(docs_frame(spark, texts).limit(0)).collect() == []


def test_paragraph_dedup_finds_near_copies_and_leaves_others(spark):
    base = prose(11, 200)
    texts = [" ".join(base), "intro\n" + " ".join(changed(base, [100], 1)), " ".join(prose(12, 200)), "\n".join([" ".join(base[:50])] * 2), None, " ".join(changed(base, range(0, 200, 4), 2))]
    rows = {(r.doc_id, r.no): r.keeper.asDict() for r in paragraphs.repeated_paragraphs(docs_frame(spark, texts)).collect()}
    assert rows == {(0, 0): {"doc_id": 0, "no": 0}, (1, 1): {"doc_id": 0, "no": 0}, (3, 0): {"doc_id": 3, "no": 0}, (3, 1): {"doc_id": 3, "no": 0}}
    left = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(docs_frame(spark, texts)).collect()}
    assert left[1] == "intro" and left[3] == " ".join(base[:50]) and left[2] == texts[2] and left[4] is None


def base_twin(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set()
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_rules_count_as_the_twin_and_score_by_ratio(spark):
    good, bad = [" ".join(prose(s, 80, 60)) for s in range(6)], [" ".join(f"z{v}" for v in np.random.default_rng(s).integers(0, 60, 80)) for s in range(6)]
    texts = good + bad + [None, "", "a b c a b c a b c\na b\na b\n\n\n", "é# *$ été x", "x " * 60]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(7, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    df = docs_frame(spark, texts)
    rows = quality.judge(df, labels).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [base_twin(t) for t in texts]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert min(r.score for r in rows[:6]) > 0 > max(r.score for r in rows[6:12]) and not any(r.kept for r in rows if r.base_failed)
    assert sorted(r.doc_id for r in quality.keep_good(df, labels).collect()) == [r.doc_id for r in rows if r.kept]
    assert quality.judge(df.limit(0), labels).collect() == []
    assert all(r.score == 0 for r in quality.judge(df, labels.limit(0)).collect())


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, tokenizer):
    path, pattern, twin = tokenizer
    texts = [None, "", " ", "Hello world, it's 12345 o'clock", "aaaaaaaaaaaaaaaaaaaaaaab" * 50, "été 你好 😀 ‍́ \x00\r\n\n  x", "<|endoftext|>", "\t\t  \n" * 40, "x" * 5000, "ab " * 9000]
    rng = np.random.default_rng(1)
    texts += ["".join(chr(c) for c in rng.choice([32, 10, 39, 97, 98, 115, 233, 0x4E2D, 0x1F600, 48], 300)) for _ in range(20)]
    rows = bpe.encode(docs_frame(spark, texts), path, pattern).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [twin.encode_ordinary(t or "") for t in texts]
    out = bpe.digests(docs_frame(spark, texts), path, pattern).orderBy("doc_id").collect()
    for r, t in zip(out, texts):
        ids = twin.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    decoded = bpe.decode(bpe.encode(docs_frame(spark, texts), path, pattern), path).orderBy("doc_id").collect()
    assert [bytes(r.bytes).decode() for r in decoded] == [t or "" for t in texts]


def luhn_number(stem):
    for d in "0123456789":
        if pii.luhn(stem + d):
            return stem + d


def test_base_spans_follow_the_contract(spark):
    card = luhn_number("411111111111111")
    text = f"é mail a.b@c-d.org, 10.0.0.255 and 10.0.0.256 or 1.2.3.4.5; card {card[:4]} {card[4:8]}-{card[8:]} {card[:-1]}{(int(card[-1]) + 1) % 10} call +49 (30) 123-4567 8 +1 23"
    field = pii.train(pii.labelled_sentences(spark))
    rows = pii.find(docs_frame(spark, [text, None, "", "no data here"]), field).orderBy("doc_id").collect()
    want = []
    for kind, pattern in (("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and pii.luhn(digits) if digits else False, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                want.append((m.start(), pii.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    base = ",".join(w[2] for w in sorted(want))
    assert rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(rows[0].spans.split(","))
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == tuple(sum(w[1] == k for w in want) for k in range(4))
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows[1:]) and rows[1].spans == ""


def test_the_field_finds_held_out_names(spark):
    rows = pii.labelled_sentences(spark)
    field = pii.train(rows.where("sentence % 4 <> 0"))
    held = {}
    for r in rows.where("sentence % 4 = 0").orderBy("sentence", "no").collect():
        held.setdefault(r.sentence, []).append((r.word, r.label))
    hit = total = 0
    texts = [" ".join(w for w, _ in s) for s in held.values()]
    block = blocks.Block(__import__("pyarrow").array(texts))
    for s, text, spans in zip(held.values(), texts, pii.added_spans(field, block, texts)):
        at = 0
        for w, label in s:
            total += label != "out"
            hit += label != "out" and any(a <= at < b and k == label for a, b, k in spans)
            at += len(w) + 1
    assert total and hit / total > 0.85


def test_secret_scan_keeps_secrets_and_drops_digests(spark):
    key = "AKIA" + "Q7Z2M4N8X1C5V9B3"
    text = f'é api_key = "{key}" and commit {"a1b2c3d4e5" * 4} fixed'
    out = secrets.scan(docs_frame(spark, [text, None, "", "plain words"]), secrets.train(secrets.labelled_findings(spark))).orderBy("start").collect()
    assert [(text[r.start : r.stop], r.is_secret) for r in out] == [(key, True), ("a1b2c3d4e5" * 4, False)]
    assert out[0].value_sha256 == hashlib.sha256(key.encode()).hexdigest()


def test_held_out_findings(spark):
    rows = secrets.labelled_findings(spark, 900)
    part = F.pmod(F.xxhash64("value", "before"), F.lit(4))
    model = secrets.train(rows.where(part != 0))
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(secrets.features(rows.where(part == 0)))
    assert model.transform(table).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.95


def test_warc_reads_back_every_page(spark, tmp_path):
    big = "x" * 300_000
    rows = [(5, "u", "a"), (2, None, "a"), (3, "u\r\nBad: 1", None), (4, "", ""), (6, "é", "été\r\n\r\nWARC/1.1\r\n"), (7, "u", big), (1, "u", big)]
    pages = spark.createDataFrame([r + ("clash", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")
    got = {r.page_id: r for r in warc.page_archive(pages, f"file://{tmp_path}/one").collect()}
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    for i, _, html in rows:
        data = (html or "").encode()
        f = first[html or ""]
        want = (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
        assert tuple(got[i])[:5] == want
    assert warc.page_archive(pages.limit(0), f"file://{tmp_path}/two").collect() == []


def test_mix_meets_targets_and_repeats(spark):
    texts = [" ".join(["w"] * n) for n in [5, 9, 0, 30, 7, 12, 40, 3, 3, 8, 100, 1]] + [None]
    df = docs_frame(spark, texts)
    labels = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (None, 1)], "doc_id long, quality int")
    rows = sorted(tuple(r) for r in mixing.mix_sources(df, labels).collect())
    assert rows == sorted(tuple(r) for r in mixing.mix_sources(df.repartition(7), labels).collect())
    assert [r[1] for r in rows] == [len((t or "").split()) for t in texts] and all(0 <= r[4] <= 2 * r[1] for r in rows)
    for target in {r[3] for r in rows}:
        assert abs(sum(r[4] for r in rows if r[3] == target) - target) <= 1
    assert sum({(r[2], r[3]): r[3] for r in rows}.values()) <= 1.5 * sum(r[1] for r in rows) + 1e-6
    assert mixing.mix_sources(df.limit(0), labels).collect() == []


def test_nearest_vectors_reach_the_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32) + 3 * rng.normal(size=(12, 24)).astype(np.float32)[rng.integers(0, 12, 1500)]
    x[7], x[8], x[9] = x[6], 0, x[6] * 2
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5001, [float("nan")] * 24, 1), (None, x[0].tolist(), 1), (5002, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    asked = df.where("pmod(vec_id, 50) = 0")
    got = {}
    for r in ann.nearest(df, asked).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d = x.astype(float)
    keep = np.flatnonzero((d != 0).any(1))
    unit = d[keep] / np.linalg.norm(d[keep], axis=1)[:, None]
    hit = 0
    for q in [i for i in keep if i % 50 == 0]:
        s = unit @ (d[q] / np.linalg.norm(d[q]))
        s[keep == q] = -2
        best = keep[np.lexsort((keep, -s))[:5]]
        mine = sorted(got[q])
        hit += len(set(best) & {m[1] for m in mine})
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        assert all(abs(m[2] - unit[keep == m[1]][0] @ (d[q] / np.linalg.norm(d[q]))) < 1e-9 for m in mine)
    assert hit / (5 * len(got)) >= 0.9 and len(got) == sum(i % 50 == 0 for i in keep)
    assert ann.nearest(df.limit(0), asked.limit(0)).collect() == []
    few = ann.nearest(df.where("vec_id IN (50, 51, 52)"), df.where("vec_id = 50")).collect()
    assert sorted(r.vec_id for r in few) == [51, 52]


@pytest.mark.parametrize("pairs_up_to", [8, 0])
def test_groups_that_share_much_and_link_little_are_resolved_in_blocks(spark, monkeypatch, pairs_up_to):
    monkeypatch.setattr(connected, "PAIRS_UP_TO", pairs_up_to)
    monkeypatch.setattr(connected, "BLOCK_SIZE", 1 << 10)
    base, rng = prose(21, 120), np.random.default_rng(22)
    texts = [" ".join(changed(base, rng.choice(120, 4 if k % 3 else 2, replace=False), k)) for k in range(60)]
    texts += [t + " end" for t in texts[::7]]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(len(sets), links)
    assert 5 < len(set(want)) < len(want)
    assert [r.component_id for r in jaccard.similar_documents(docs_frame(spark, texts)).orderBy("doc_id").collect()] == want
    groups = {}
    for r in paragraphs.repeated_paragraphs(docs_frame(spark, texts)).collect():
        groups[r.doc_id] = r.keeper.doc_id
    assert [groups.get(i, i) for i in range(len(texts))] == want
    stem = "the same forty characters of a long line"
    rows = [stem[:20] + "".join(rng.choice(list("abcé"), 4)) + stem[20:] + f" {k % 5}" for k in range(70)]
    assert [r.text for r in lines.dedup_lines(docs_frame(spark, rows)).orderBy("doc_id").collect()] == brute_lines(rows)
