import base64
import itertools

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
import __spark_entry__ as entry
from nubes.llm import jaccard, quality, queries
from test_operators import changed, components, prose, shingles

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= names


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == cp.COLUMNS, name
        assert 0 < docs.count() <= 2 * n
        if name == "jaccard_join":
            assert jaccard.similar_documents(docs).where("doc_id <> component_id").isEmpty()
    assert cp.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
    assert stage(spark, docs.limit(0), DATA).isEmpty()


def shingle_links(texts):
    sets = [shingles(t) for t in texts]
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def test_run_equals_a_plain_run(spark, tmp_path):
    """Every stage against brute force on its own input: nulls, empty texts, repeated rows, ties, shared ids and null sources."""
    base = [prose(s, 90, 3000) for s in range(5)]
    rows = [(i, " ".join(w), "en", f"s{i % 2}") for i, w in enumerate(base)]
    # near copies of whole documents, too far apart to be near copies of lines; the last is a near copy of a line
    rows += [(10 + s, " ".join([*base[s][:30], "anotherwordhere", *base[s][31:60], "yetanotherword", *base[s][61:]]), "en", "s1") for s in range(2)]
    rows += [(12, " ".join(changed(base[2], [40], 2)), "en", "s1")]
    rows += [(3, " ".join(prose(50, 80, 3000)), "en", None), (3, rows[3][1], "en", "s1"), (None, " ".join(prose(51, 70, 3000)), "en", "s0"), (20, None, "en", "s0"), (21, "", None, None), (22, "too short", "en", "s0")]
    line = " ".join(prose(60, 12, 3000))
    rows += [(30 + k, " ".join(prose(61 + k, 60, 3000)) + "\n" + line + ("" if k < 2 else "!"), "en", "s0") for k in range(3)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    root = f"file://{tmp_path}"
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(5), None, 10, 11, 12, 30, 31, 32]], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    now, kept = docs, {}
    for name, stage in cp.STAGES[:-1]:
        before = now.collect()
        now = stage(spark, now, root).cache()
        after = kept[name] = now.collect()
        if name == "quality_rules":
            good = {(r.doc_id, r.text) for r in quality.judge(docs, cp._labels(spark, root)).where("kept").select("doc_id").join(docs, "doc_id").collect()} | {(None, r[1]) for r in rows if r[0] is None}
            assert {(r.doc_id, r.text) for r in after} <= good and not any(r.text is None or len(r.text.split()) < 50 for r in after)
        elif name == "line_dedup":
            assert sum(line in r.text for r in before) == 3 and sum(line in r.text for r in after) == 1
            # a document of one line goes with its line: the copy under the id 3 stands beside its first one, as rows of one id are one document
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {12}
        elif name == "jaccard_join":
            texts, groups = [r.text for r in before if r.doc_id is not None], {}
            known = [r for r in before if r.doc_id is not None]
            for r, c in zip(known, components(len(texts), shingle_links(texts))):
                groups.setdefault(c, []).append(r)
            want = [min(r.doc_id for r in g) for g in groups.values()] + [None for r in before if r.doc_id is None]
            assert sorted((r.doc_id for r in after), key=repr) == sorted(want, key=repr)
        else:
            words = lambda rs: sum(len(r.text.split()) for r in rs)
            assert abs(words(after) - 1.5 * words(before)) <= 3 and {r.text[:20] for r in after} <= {r.text[:20] for r in before}
    path, twin = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), []
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in kept["source_mix"]:
        twin.append((r.doc_id, len(encoding.encode_ordinary(r.text))))
    out = cp.run(spark, root).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=repr) == sorted(twin, key=repr)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), root).isEmpty(), name
