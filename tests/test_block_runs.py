"""Runs in blocks that are broken off and taken up again, and checks of caches."""

import pytest

from nubes.sources.block_runs import AlreadyClaimed, BlockRun, CacheMismatch, ParametersDiffer, checked_cache

SCHEMA = "value long, n int, effect string"
BLOCKS = [{"n": n, "effect": e} for n in (10, 20) for e in ("drop", "invent")]


def test_a_broken_run_goes_on_where_it_was(spark, tmp_path):
    path, asked = str(tmp_path / "run"), []

    def compute(block, fail=()):
        asked.append((block["n"], block["effect"]))
        if (block["n"], block["effect"]) in fail:
            raise ValueError("no such cloud\nmore")
        return spark.range(block["n"]).selectExpr("id AS value", f"{block['n']} AS n", f"'{block['effect']}' AS effect")

    with BlockRun(spark, path, ["n", "effect"], {"seed": 1}) as run:
        assert run.frame(SCHEMA).count() == 0
        first = run.run(BLOCKS[:3], lambda b: compute(b, fail={(10, "invent")}))
    assert [r["status"] for r in first] == ["ok", "failed", "ok"] and first[1]["error"] == "ValueError: no such cloud"
    asked.clear()
    with BlockRun(spark, path, ["n", "effect"], {"seed": 1}) as run:
        assert [r["status"] for r in run.run(BLOCKS, compute)] == ["kept", "ok", "kept", "ok"]
        rows = run.frame(SCHEMA)
    assert asked == [(10, "invent"), (20, "invent")]
    assert {(r.n, r.effect): r["count"] for r in rows.groupBy("n", "effect").count().collect()} == {(b["n"], b["effect"]): b["n"] for b in BLOCKS}


def test_half_a_block_is_not_finished(spark, tmp_path):
    path = str(tmp_path / "run")
    spark.range(3).selectExpr("id AS value").write.parquet(f"{path}/blocks/n=10/effect=drop")
    (tmp_path / "run/blocks/n=10/effect=drop/_SUCCESS").unlink()
    with BlockRun(spark, path, ["n", "effect"], {}) as run:
        assert not run.finished(BLOCKS[0])
        run.run(BLOCKS[:1], lambda b: spark.range(5).selectExpr("id AS value"))
        assert run.frame(SCHEMA).count() == 5


def test_other_parameters_and_a_second_writer_are_refused(spark, tmp_path):
    path = str(tmp_path / "run")
    with BlockRun(spark, path, ["n"], {"seed": 1, "k": 2}) as run:
        with pytest.raises(AlreadyClaimed):
            BlockRun(spark, path, ["n"], {"seed": 1, "k": 2}).__enter__()
    with BlockRun(spark, path, ["n"], {"seed": 2, "k": 2}) as run:  # nothing is finished, so the new ones hold
        run.run([{"n": 1}], lambda b: spark.range(1))
    with pytest.raises(ParametersDiffer, match="seed: stored 2, now 3"):
        BlockRun(spark, path, ["n"], {"seed": 3, "k": 2}).__enter__()
    with BlockRun(spark, path, ["n"], {"seed": 2, "k": 2}) as run:  # the refused one has left no claim
        assert run.finished({"n": 1})
    with pytest.raises(AlreadyClaimed, match="context"):
        run.run([{"n": 2}], lambda b: spark.range(1))


def test_caches_are_checked(spark):
    rows = spark.createDataFrame([(i, layer, [1.0, 2.0]) for i in range(4) for layer in (3, 7)], "item_id long, layer_index int, x array<double>")
    manifest = {"n_items": 4, "layer_indices": [3, 7], "model": "m"}
    assert checked_cache(rows, manifest, {"model": "m"}).count() == 8
    for bad, expect, what in (
        (manifest, {"model": "other"}, "model: expected 'other'"), (manifest, {"pooling": "mean"}, "no such field"), ({"model": "m"}, None, "n_items"),
        (manifest | {"n_items": 5}, None, "n_items: expected 5"), (manifest | {"layer_indices": [3]}, None, "layer_indices"),
    ):
        with pytest.raises(CacheMismatch, match=what):
            checked_cache(rows, bad, expect)
    with pytest.raises(CacheMismatch, match="rows: expected"):
        checked_cache(rows.unionAll(rows.limit(1)), manifest)
    with pytest.raises(CacheMismatch, match="n_items"):
        checked_cache(rows.where("item_id < 3 OR layer_index = 3"), manifest)
    with pytest.raises(CacheMismatch, match="length"):
        checked_cache(rows.selectExpr("item_id", "layer_index", "IF(item_id = 1, array(1.0D), x) AS x"), manifest)
