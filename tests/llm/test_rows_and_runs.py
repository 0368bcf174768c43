"""Rows of the pipeline without an id of their own, and secrets of any length."""

import base64
import hashlib

import pytest

import corpus_pipeline as cp
from nubes.llm import secrets
from test_operators import prose


def test_stages_lose_no_row_that_is_no_duplicate(spark, tmp_path):
    a, b, c, d = (" ".join(prose(s, 30)) for s in range(4))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (3, d)]], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.jaccard_join(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, a), (1, b), (None, c), (None, c), (3, d)], key=repr)
    spark.createDataFrame([(9, 1)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    mixed = cp.source_mix(spark, out, f"file://{tmp_path}").collect()
    assert {(r.doc_id, r.text) for r in mixed} >= {(1, a), (1, b), (None, c), (3, d)}
    # 5 rows of 30 words, one source: the target is 1.5 times as many words
    assert sum(len(r.text.split()) for r in mixed) == 225


@pytest.mark.parametrize("value, before", [
    (base64.b64encode(hashlib.sha512(b"a").digest() + hashlib.sha512(b"b").digest()).decode(), 'private_key = "'),
    (hashlib.sha512(b"c").hexdigest(), "digest "),
    ("qXzJkVbWyHgRtPmLsDfNcQwEuIoAaSdFgHjKlZxCvBnMqWeRtY", "api_key: "),
])
def test_values_of_any_length_are_whole_candidates(spark, value, before):
    docs = spark.createDataFrame([(1, f"é {before}{value}\n and on", "src")], "doc_id long, text string, source string")
    assert [(r.start, r.value) for r in secrets.candidates(docs).collect()] == [(2 + len(before), value)]
