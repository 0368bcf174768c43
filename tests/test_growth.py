"""Steps whose cost once grew faster than their input."""

import tracemalloc

import pytest

from nubes.functions import statistics as st


def test_binomial_interval_holds_no_list_of_outcomes():
    tracemalloc.start()
    low, high = st.binomial_interval(1_000_000, 4_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
    half = 1.959964 * (0.25 * 0.75 / 4_000_000) ** 0.5
    assert (low, high) == pytest.approx((0.25 - half, 0.25 + half), abs=1e-6)


def test_no_word_is_cast_that_is_no_number(spark, tmp_path):
    from nubes.plans.data_queries import coerced_values

    rows = [(1, "en", "12 007 1e5 12ab (3) 4.5 999999999 1234567890 0x1F nan 5D\n8"), (2, "en", "none"), (3, None, "7"), (None, "en", "1"), (4, "de", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = coerced_values(spark, str(tmp_path))
    assert sorted((r.lang or "", r.n, r.numbers, r.total) for r in out.collect()) == [("", 1, 1, 7), ("en", 13, 7, 12 + 7 + 3 + 4 + 5 + 999999999 + 8)]
    assert "^[0-9]+$" in out._jdf.queryExecution().optimizedPlan().toString()


def _reads(df, name: str) -> bool:
    return any(name in f for f in df.inputFiles())


def test_packets_and_folds_are_derived_from_their_tables_once(spark):
    from nubes.functions import models
    from nubes.plans import pool_queries, stat_queries

    assert not _reads(pool_queries.alpha_rates(spark, "/root/testdata/sf0.001"), "lineitem.parquet")
    rows = models.text_features(stat_queries.labelled(spark, "/root/testdata/sf0.001"))
    scored = models.out_of_fold(rows, "quality", lambda t: models.LinearRegression(labelCol="quality", solver="normal").fit(t), lambda t: t.withColumnRenamed("prediction", "score"))
    assert scored.count() == rows.count() and not _reads(scored, "documents.parquet")
