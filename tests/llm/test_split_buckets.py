"""Buckets of keys that a task can't sort at once are split; only a key that very many items have is sorted as rows."""

import numpy as np

from nubes.llm import components
from nubes.llm.components import packed
from nubes.plans.scratch import Scratch


def test_large_buckets_of_many_keys_stay_packed(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    keys = rng.permutation(np.repeat(rng.integers(0, 1 << 63, 500, dtype=np.uint64), 3))
    items = np.arange(len(keys)) - 700
    groups = {}
    for key, item in zip(keys.tolist(), items.tolist()):
        groups.setdefault(key, []).append(item)
    parts = [packed(keys[k : k + 400], items[k : k + 400], 3) for k in range(0, len(keys), 400)]
    rows = [row for part in parts for row in zip(*(column.to_pylist() for column in part))]
    frame = spark.createDataFrame(rows, "bucket int, keys binary, items binary").repartition(3)
    monkeypatch.setattr("nubes.plans.scratch.shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(components, "SORTED_UP_TO", 60)  # a bucket holds some 500 keys
    monkeypatch.setattr(components, "with_least", None)  # keys as rows
    met = components.meetings(frame, Scratch(spark, "keys"), "met").collect()
    assert sorted((r.key, r["item"]) for r in met) == sorted((min(g), item) for g in groups.values() for item in g)
