import json

import pytest

from nubes.operators import sampling
from nubes.sources.block_runs import AlreadyClaimed
from nubes.sources import pairs, store


def test_canonical_drops_blank_and_repeated(spark):
    raw = [("k", "q", "a", "b", 1), ("k", " q ", "c", "d", 2), (None, " ", "a", "b", 3), ("k", "r", "a", "\t", 4), (None, "s", "x", "x", 5)]
    df = spark.createDataFrame(raw, "knowledge string, question string, right_answer string, hallucinated_answer string, i int")
    assert [r.i for r in pairs.canonical(df, "i", "s", drop_repeated=True).orderBy("i").collect()] == [1, 5]
    row = pairs.audit(pairs.canonical(df, "i", "s", drop_empty=False)).first()
    assert (row.n_rows, row.n_empty_prompt, row.n_empty_hallucinated, row.n_duplicate_prompt_ids, row.n_correct_equals_hallucinated) == (5, 1, 1, 1, 1)
    with pytest.raises(ValueError, match="missing"):
        pairs.canonical(df.drop("question"), "i", "s")


def test_records_as_array_or_lines(spark, tmp_path):
    rows = [{"a": 1}, {"a": 2}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": oops}\n')
    assert pairs.read_records(spark, str(tmp_path / "x.json"), "a long").count() == 2
    assert [r.a for r in pairs.read_records(spark, str(tmp_path / "y.jsonl"), "a long", strict=False).collect()] == [1, 2]
    with pytest.raises(Exception):
        pairs.read_records(spark, str(tmp_path / "y.jsonl"), "a long").collect()


def test_id_set_digests_differ_in_repeats_only(spark):
    one, two = spark.createDataFrame([("b",), ("a",)], "i string"), spark.createDataFrame([("a",), ("b",), ("b",)], "i string")
    assert pairs.id_set_digest(one, "i") == pairs.id_set_digest(two, "i", repeats=False) != pairs.id_set_digest(two, "i")
    assert not pairs.same_rows(one, two) and pairs.same_rows(one, one)


def test_store_resumes_replaces_and_refuses(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "store"))
    configs = store.configs_frame(spark, [{"experiment_id": f"e{i}", "experiment_family": "f", "dataset": "d", "seed": i} for i in range(4)])
    fails = lambda c: {"mmd": 1.0 / (c["seed"] - 2)}
    assert store.run_grid(s, configs, fails) == 4 and store.run_grid(s, configs, fails) == 0
    assert s.manifest()["failed"] == 1
    assert store.run_grid(s, configs, lambda c: {"mmd": 5.0}, retry_failed=True) == 1
    assert s.manifest()["failed"] == 0 and s.frame().count() == 4 and s.broken_keys().isEmpty()
    with pytest.raises(ValueError, match="twice"):
        s.append(s.frame())
    (tmp_path / "store/_claim").touch()  # as another writer would
    with pytest.raises(AlreadyClaimed):
        s.replace(s.frame())
    (tmp_path / "store/_claim").unlink()
    s.replace(s.frame())
    assert s.frame().count() == 4 and not (tmp_path / "store/_claim").exists()
    with pytest.raises(ValueError, match="unknown"):
        store.result_row({"experiment_id": "x"}, {"nope": 1.0}, 0.0)
    with pytest.raises(ValueError):
        store.config_key({"alpha": float("nan")})


def test_grids_have_the_stated_sizes_and_ids_parse(spark):
    assert (len(store.floor_configs()), len(store.drop_invent_configs())) == (90, 160)
    configs = store.mixture_configs([9], [0.01, 0.5], 2)
    rows = store.parse_ids(store.configs_frame(spark, configs).select("experiment_id")).collect()
    assert {(r.family, r.alpha) for r in rows} == {("l3", None), ("l3d", None), ("l3e", None), ("l4a", 0.01), ("l4a", 0.5), ("l4b", 0.01), ("l4b", 0.5)}
    with pytest.raises(Exception, match="unknown experiment id"):
        store.parse_ids(spark.createDataFrame([("l9/x",)], "experiment_id string")).collect()


def test_splits_keep_groups_whole(spark):
    df = spark.range(100).selectExpr("id", "id % 20 as g")
    split = sampling.group_split(df, "g", seed=1)
    assert split.groupBy("g").agg({"part": "approx_count_distinct"}).selectExpr("max(`approx_count_distinct(part)`)").first()[0] == 1
    assert {r.part: r["count"] for r in split.groupBy("part").count().collect()} == {"dev": 60, "val": 20, "test": 20}
    folds = sampling.group_folds(df.where("g < 18"), "g", 5)
    assert sorted(r["count"] for r in folds.select("g", "fold").distinct().groupBy("fold").count().collect()) == [3, 3, 4, 4, 4]
    with pytest.raises(ValueError):
        sampling.group_split(df.where("g < 2"), "g")


def test_replacement_is_nested_and_packets_disjoint(spark):
    df = spark.range(40).selectExpr("id as pid", "0 as x", "1 as y")
    small, large = ({r.pid for r in sampling.replaced(df, a).where("replaced").collect()} for a in (0.1, 0.5))
    assert len(small) == 4 and small < large and len(large) == 20
    kinds = spark.range(60).selectExpr("id", "if(id < 40, 'correct', 'hallucinated') as kind")
    rows = sampling.packet(kinds, "kind", "id", 10, 0.3).collect()
    assert len({(r.kind, r["item"]) for r in rows}) == 20 and sum(r.kind == "hallucinated" for r in rows) == 3
    with pytest.raises(ValueError):
        sampling.packet(kinds, "kind", "id", 25, 0.3)
