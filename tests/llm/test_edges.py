"""Nulls, empty tables, repeated rows, very long texts and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from nubes.llm import bpe, jaccard, lines, mixing, paragraphs, pii, quality, secrets
from test_operators import base_twin, docs_frame, luhn_number, prose, tokenizer  # noqa: F401

LONG = "\n".join(" ".join(prose(s, 40, 9000)) + f" {s}." for s in range(1500))  # about 60,000 words
#: Columns named like those the operators make.
CLASHES = ["gone", "gone_from", "n_removed", "item", "key", "component", "size", "kind", "score", "start", "k", "slot", "spans"]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, LONG, "en", "s"), (1, LONG, "en", "s"), (2, None, "en", None), (3, "", None, "s"), (None, LONG, "en", "s"), (4, "only this line of the text is new to the table.\n" + LONG[:2000], "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")


def test_lines(spark, wide):
    out = lines.dedup_lines(wide, short=True)
    assert set(out.columns) == set(wide.columns) and lines.dedup_lines(wide.limit(0), short=True).isEmpty()
    rows = out.orderBy("doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    # rows of one id and text stand as one document, so their lines are no copies of each other
    assert [r.text for r in by[1]] == [LONG, LONG] and by[None][0].text == LONG and by[2][0].text is None and by[3][0].text == ""
    assert by[4][0].text.split("\n")[0].startswith("only this") and by[4][0].n_removed >= 8 and by[4][0].gone == 7


def test_paragraphs(spark, wide):
    out = paragraphs.dedup_paragraphs(wide, passages=True)
    assert set(out.columns) == set(wide.columns) and paragraphs.dedup_paragraphs(wide.limit(0), passages=True).isEmpty()
    by = {r.doc_id: r for r in out.collect()}
    assert by[None].text == LONG and by[2].text is None and by[3].text == "" and by[4].text.startswith("only this line") and len(by[4].text) < 600


def test_jaccard(spark, wide):
    rows = jaccard.similar_documents(wide).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4)] and len(rows) == 6


def test_quality(spark, wide):
    rows = {r.doc_id: r for r in quality.judge(wide, labels(spark)).collect()}
    words = LONG.split()
    assert rows[1].n_words == len(words) and rows[1].word_chars == sum(map(len, words)) and not rows[1].base_failed
    assert rows[2].n_words == 0 and rows[2].base_failed and (rows[4].n_words, rows[4].word_chars, rows[4].n_symbols, rows[4].n_dup_lines, rows[4].n_repeat_words) == base_twin("only this line of the text is new to the table.\n" + LONG[:2000])
    assert quality.judge(wide, labels(spark)).count() == 6


def test_bpe(spark, wide, tokenizer):  # noqa: F811
    path, pattern, twin = tokenizer
    rows = bpe.digests(wide, path, pattern).collect()
    ids = twin.encode_ordinary(LONG)
    want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LONG.encode()).hexdigest())
    assert sum((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want for r in rows) == 3 and len(rows) == 6
    assert bpe.digests(wide.limit(0), path, pattern).isEmpty()


def test_personal_data(spark, wide):
    field = pii.train(pii.labelled_sentences(spark))
    card = luhn_number("411111111111111")
    texts = [f"{LONG}\n{card} a@b.c 1.2.3.4 +1 (555) 555-0100", f"{card} {card}", None, ""] * 2
    rows = pii.find(docs_frame(spark, texts, [1, 2, 3, 4, 1, 2, 3, 4]), field).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows] == [(1, 1, 1, 1)] * 2 + [(0, 0, 0, 0)] * 6  # two cards in a row are one match of too many digits
    assert rows[0].spans == rows[1].spans and f"card:{len(LONG) + 1}:{len(LONG) + 17}" in rows[0].spans
    assert pii.find(wide.limit(0), field).isEmpty() and pii.find(wide, field).count() == 6


def test_secrets(spark, wide):
    model = secrets.train(secrets.labelled_findings(spark))
    key = "AKIA" + "Q7Z2M4N8X1C5V9B3"
    df = docs_frame(spark, [f"{LONG} key = {key}", f"{LONG} key = {key}", None, ""], [1, 1, 2, 3])
    rows = secrets.scan(df, model).collect()
    assert [(r.doc_id, r.start) for r in rows if r.is_secret] == [(1, len(LONG) + 7)] * 2
    assert secrets.scan(wide.limit(0), model).isEmpty() and secrets.scan(wide, model).where("is_secret").isEmpty()


def test_mixing(spark, wide):
    rows = mixing.mix_sources(wide, labels(spark)).collect()
    assert len(rows) == 6 and sum(r.size for r in rows) == 3 * len(LONG.split()) + len(("only this line of the text is new to the table.\n" + LONG[:2000]).split())
    assert mixing.mix_sources(wide.limit(0), labels(spark)).isEmpty()


def test_candidates_of_secrets_equal_a_plain_scan(spark):
    """Every match of a format in order, as Python's scanner finds them, with its place in code points."""
    import re

    formats = [p for k, p in secrets.FORMATS.items() if k != "assigned"]
    plain = re.compile("|".join(formats))
    texts = ["é ghp_" + "a1" * 18 + " x AKIA" + "Q7Z2M4N8" * 2 + "\nsk_live_" + "b2" * 10, "d" * 31 + " " + "0123456789abcdef" * 3 + " eyJ" + "a" * 9 + "." + "b" * 9 + ".c", "-----BEGIN RSA PRIVATE KEY-----\nabc", "xoxb-" + "1" * 12, "none", None]
    got = sorted((r.doc_id, r.start, r.value) for r in secrets.candidates(docs_frame(spark, texts)).collect())
    assert got == sorted((i, m.start(), m.group()) for i, t in enumerate(texts) for m in plain.finditer(t or ""))
