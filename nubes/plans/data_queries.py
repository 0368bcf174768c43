"""Queries of sources, splits, sampling, generators, the result store and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.operators import generators, sampling, transforms
from nubes.plans.ordered import order_statistics
from nubes.plans.scratch import Scratch
from nubes.sources import grids, pairs, store
from nubes.streaming import incremental


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pairs(spark, sf_dir) -> DataFrame:
    """User turns as questions, the next turn's text as the right answer, the one after as the other; the conversation's first
    word as knowledge."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    at = lambda k, name: t.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias(name))
    rows = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(at(1, "right_answer"), ["conv_id", "turn"], "left").join(at(2, "hallucinated_answer"), ["conv_id", "turn"], "left")
    return rows.withColumn("knowledge", F.substring("question", 1, 5)).withColumn("row_id", F.col("conv_id") * 1000000 + F.col("turn"))


def canonical_pairs(spark, sf_dir):
    out = pairs.canonical(raw_pairs(spark, sf_dir), "row_id", "conversations", drop_repeated=True)
    return out.select("prompt_id", "row_id", F.length("correct_answer").alias("n_correct"), F.length("hallucinated_answer").alias("n_other"))


def audit_pairs(spark, sf_dir):
    return pairs.audit(pairs.canonical(raw_pairs(spark, sf_dir), "row_id", "conversations", drop_empty=False))


def document_split(spark, sf_dir):
    return sampling.group_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=7)


def conversation_folds(spark, sf_dir):
    return sampling.group_folds(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", 5, seed=500)


def class_balanced(spark, sf_dir):
    return sampling.class_balanced(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 103, seed=3)


def kinds(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality IS NOT NULL AND n_chars IS NOT NULL")
    return t.select("doc_id", F.when(F.col("quality") == 1, "correct").otherwise("hallucinated").alias("kind"), "n_chars")


def length_matched(spark, sf_dir):
    return sampling.length_matched(kinds(spark, sf_dir), "kind", "n_chars", "doc_id").select("doc_id", "kind", "bin")


def length_matched_sample(spark, sf_dir):
    return sampling.length_matched(kinds(spark, sf_dir), "kind", "n_chars", "doc_id", most=40, seed=11).select("doc_id", "kind", "bin")


def alpha_replacement(spark, sf_dir):
    """Each vector beside the one of the next id; a quarter of the positions take the latter."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.element_at("embedding", 1).cast("double").alias("x"))
    both = t.join(t.select((F.col("pid") - 1).alias("pid"), F.col("x").alias("y")), "pid")
    return sampling.replaced(both, 0.25, seed=5)


def shuffled_labels(spark, sf_dir):
    return sampling.shuffled_labels(table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select("doc_id", "quality"), "quality", "doc_id", seed=2)


def null_halves(spark, sf_dir):
    return sampling.null_halves(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 100, seed=4)


def packets(spark, sf_dir):
    """A packet of 8 items with half of Q replaced, over the labelled documents."""
    return sampling.packet(kinds(spark, sf_dir), "kind", "doc_id", 8, 0.5, seed=9)


def mode_reference(spark, sf_dir):
    return generators.mode_table(spark, 8, 8.0).select("mode", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def generated_clouds(spark, sf_dir):
    """Sizes and rounded means of each generator's cloud."""
    g, n = generators, 480
    ring8, square4 = g.matched_pair(n)
    samplers = {
        "gaussian": g.gaussian([1.0, 0.0], [[1.0, 0.5], [0.5, 2.0]]), "cube": g.cube(), "ball": g.ball(3), "ring": g.ring(thickness=0.2), "mixture": g.mixture(1.0, 4), "reference": g.dropped_and_invented(8, n),
        "dropped": g.dropped_and_invented(8, n, drop=0.25), "invented": g.dropped_and_invented(8, n, invent=0.5), "pairs": g.dropped_pairs(8, n, [(0, 4)]), "mass": g.exact_mass(8, n, 60), "ring8": ring8, "square4": square4,
    }
    out = None
    for name, sampler in samplers.items():
        part = g.generate(g.requests(spark, [(name, n, 42)]), sampler)
        out = part if out is None else out.unionAll(part)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return out.groupBy("cloud_id").agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"), F.round(F.avg(F.element_at("x", 1)), 6).alias("mean_1"))


def image_sweep(spark, sf_dir):
    """Images out of vectors (64 components as 8 x 8 pixels) at every brightness and contrast of a grid: their mean pixel."""
    t = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    images = t.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 64 + 128).cast("int")))).alias("pixels"))
    out = None
    for severity in (0.0, 0.1, 0.3):
        mean = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
        part = images.select("image_id", F.lit(severity).alias("severity"), mean(transforms.brightness(F.col("pixels"), severity)).alias("bright"), mean(transforms.contrast(F.col("pixels"), severity)).alias("flat"))
        out = part if out is None else out.unionAll(part)
    return out


def turned_images(spark, sf_dir):
    """The images of ``image_sweep`` turned by quarters: every image with every angle, and a sum of its pixels times their places."""
    t = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    images = t.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 64 + 128).cast("int")))).alias("pixels"))
    swept = transforms.sweep(images, transforms.angle_grid(4)).withColumnRenamed("value", "angle")
    out = swept.withColumn("pixels", transforms.turned(F.col("pixels"), F.col("angle"), F.lit(1.0), 8, 8))
    return out.select("image_id", "angle", F.expr("aggregate(transform(pixels, (p, i) -> p * cast(i AS bigint)), 0L, (a, v) -> a + v)").alias("weighed"))


def strongest_component(spark, sf_dir):
    """The component of largest absolute mean of every label, ties to the first."""
    t = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "v"))
    means = t.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("mean"))
    top = means.groupBy("label").agg(F.max(F.struct(F.abs("mean").alias("size"), (-F.col("i")).alias("first"), "mean")).alias("top"))
    return top.select("label", (-F.col("top.first")).alias("component"), F.col("top.mean").alias("mean"))


def coerced_values(spark, sf_dir):
    """Numbers out of texts where they are numbers: how many words of every document are, and their sum."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    words = d.select("lang", F.explode(F.split(F.translate(F.col("text"), ".,()", "    "), "[ \n]+")).alias("word")).where(F.col("word").rlike("^[0-9A-Za-z]{1,9}$"))
    # of these words exactly those of digits are numbers; a try_cast of any other one raises and catches an error
    number = F.expr("CASE WHEN word < ':' AND word RLIKE '^[0-9]+$' THEN try_cast(word AS int) END")
    return words.groupBy("lang").agg(F.count("*").alias("n"), F.count(number).alias("numbers"), F.sum(number.cast("long")).alias("total"))


def share_of_largest(spark, sf_dir):
    """Each document's size beside the largest of its source."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND n_chars IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", "n_chars")
    largest = d.groupBy("source").agg(F.max("n_chars").alias("largest"))
    return d.join(largest, "source").select("doc_id", "source", F.round(F.col("n_chars") / F.col("largest"), 9).alias("share"))


def largest_duplicate_groups(spark, sf_dir):
    """The ten texts that most documents have, ties to the smallest id."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    groups = d.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    return groups.orderBy(F.desc("n"), "first_doc").limit(10)


def size_deciles(spark, sf_dir):
    """Observed deciles of document sizes by language, from order statistics."""
    d = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL AND lang IS NOT NULL").select("lang", F.col("n_chars").cast("double").alias("n_chars"))
    return order_statistics(d, ["lang"], "n_chars", {f"p{q}": (q / 100, "lower") for q in range(10, 100, 10)})


def csv_round_trip(spark, sf_dir):
    """Documents written as CSV with a header and read back with the same schema, quotes, line ends and nulls kept apart from empty texts."""
    s = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "lang", "text")
    path = Scratch(spark, "csv").path("documents")
    s.write.options(header=True, nullValue="\\N", emptyValue="", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = spark.read.schema(s.schema).options(header=True, nullValue="\\N", multiLine=True, escape='"', enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)
    return back.select("doc_id", "lang", F.md5("text").alias("digest"))


_MIXTURES = ([9, 18, 27], [0.0, 0.01, 0.5], 4)


def every_family() -> list[grids.Family]:
    return [f for families in grids.GRIDS.values() for f in families] + grids.mixtures(*_MIXTURES)


def experiment_grid(spark, sf_dir):
    """Config keys of every grid."""
    return store.configs_frame(spark, store.configs_of(every_family())).select("experiment_id", "experiment_family", "config_key")


def parsed_ids(spark, sf_dir):
    """Layer, mode, alpha and repeat out of the ids of the mixture grids."""
    frame = store.configs_frame(spark, store.mixture_configs(*_MIXTURES)).select("experiment_id")
    return store.parse_ids(frame)


def parsed_grid_ids(spark, sf_dir):
    """The fields of the ids of the grids over spaces."""
    families = grids.GRIDS["c0"] + grids.GRIDS["c1"] + grids.GRIDS["c2r"] + grids.GRIDS["c2s"]
    frame = store.configs_frame(spark, store.configs_of(families)).select("experiment_id")
    return grids.parsed(frame, families).select("experiment_id", "family", "space", "level", "comparison", "angle", F.col("k").alias("repeat"))


def grid_run(spark, sf_dir):
    """A grid run twice into a store: results and failures by family; the second run has nothing left to do."""
    results = store.ResultStore(spark, Scratch(spark, "grid").path("store"))
    configs = store.configs_frame(spark, store.drop_invent_configs())

    def runner(config: dict) -> dict:
        if config["invent_fraction"] == 0.75:
            raise ValueError("no such cloud")
        return {"mmd": config["drop_fraction"] + config["seed"], "js": float("nan")}

    store.run_grid(results, configs, runner)
    left = store.run_grid(results, configs, runner)
    return results.frame().groupBy("experiment_family", "status").agg(F.count("*").alias("n"), F.round(F.sum("mmd"), 6).alias("mmd"), F.count("js").alias("n_js"), F.lit(left).alias("left"))


def incremental_counts(spark, sf_dir):
    """Hourly counts and sums of events, kept up to date by a stream of the table's files."""
    return incremental.hourly(spark, f"{sf_dir}/events.parquet")


_H = "md5(concat_ws('|', {0}, '{1}'))"
_EDGE = r"[\s\x1c-\x1f\x85\p{Z}]"
_RAWQ = r"""t AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS right_answer, b.text AS hallucinated_answer, substr(u.text, 1, 5) AS knowledge, u.conv_id * 1000000 + u.turn AS row_id
  FROM t u LEFT JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 LEFT JOIN t b ON b.conv_id = u.conv_id AND b.turn = u.turn + 2 WHERE u.role = 'user')"""
_KINDS = """d AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'correct' ELSE 'hallucinated' END AS kind, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
e AS (SELECT quantile_cont(n_chars, [0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS e FROM d),
b AS (SELECT d.*, CAST(len(list_filter(e, lambda x: n_chars >= x)) AS INT) AS bin FROM d, e),
q AS (SELECT bin, least(count(*) FILTER (kind = 'correct'), count(*) FILTER (kind = 'hallucinated')) AS quota FROM b GROUP BY 1)"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_EDGE}+|{_EDGE}+$', '', 'g')"


_AUDITED = {"correct_chars": "cc", "hallucinated_chars": "hc", "correct_words": "cw", "hallucinated_words": "hw", "diff_chars": "hc - cc", "diff_words": "hw - cw"}


def _audit() -> str:
    blank = lambda c: f"coalesce({_strip(c)}, '') = ''"
    words = lambda c: f"coalesce(len(regexp_extract_all({c}, '[^\\s\\x1c-\\x1f\\x85\\p{{Z}}]+')), 0)"
    figures = ", ".join(
        f"round(avg({x}), 6) AS {n}_mean, round(stddev_samp({x}), 6) AS {n}_std, CAST(min({x}) AS BIGINT) AS {n}_min, round(quantile_cont({x}, 0.5), 6) AS {n}_median, CAST(max({x}) AS BIGINT) AS {n}_max"
        for n, x in _AUDITED.items()
    )
    return f"""WITH {_RAWQ}, k AS (SELECT sha1(coalesce({_strip('knowledge')}, '') || chr(31) || coalesce({_strip('question')}, '')) AS prompt_id, {blank('question')} AS ep, {blank('right_answer')} AS ec, {blank('hallucinated_answer')} AS eh,
          coalesce({_strip('right_answer')}, '') AS c, coalesce({_strip('hallucinated_answer')}, '') AS h, coalesce(length(right_answer), 0) AS cc, coalesce(length(hallucinated_answer), 0) AS hc,
          {words('right_answer')} AS cw, {words('hallucinated_answer')} AS hw FROM r),
        u AS (SELECT count(*) AS n, coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM k GROUP BY prompt_id))
        SELECT count(*) AS n_rows, count(*) FILTER (ep) AS n_empty_prompt, count(*) FILTER (ec) AS n_empty_correct, count(*) FILTER (eh) AS n_empty_hallucinated, count(*) FILTER (NOT ec AND NOT eh) AS n_with_both_answers,
          count(*) FILTER (NOT ec AND c = h) AS n_correct_equals_hallucinated, count(*) FILTER (hc > cc) AS n_longer, count(*) FILTER (hc < cc) AS n_shorter, count(*) FILTER (hc = cc) AS n_equal, {figures},
          (SELECT n FROM u) AS n_unique_prompt_ids, (SELECT CAST(d AS BIGINT) FROM u) AS n_duplicate_prompt_ids,
          (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY c HAVING count(*) > 1)) AS n_duplicate_correct_answers, (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY h HAVING count(*) > 1)) AS n_duplicate_hallucinated_answers FROM k"""


ORACLES = {
    "audit_pairs": _audit(),
    "canonical_pairs": f"""WITH {_RAWQ}, k AS (SELECT *, sha1(coalesce({_strip('knowledge')}, '') || chr(31) || coalesce({_strip('question')}, '')) AS prompt_id FROM r
          WHERE coalesce({_strip('question')}, '') <> '' AND coalesce({_strip('right_answer')}, '') <> '' AND coalesce({_strip('hallucinated_answer')}, '') <> ''),
        f AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY row_id) AS first FROM k)
        SELECT prompt_id, row_id, CAST(length(right_answer) AS INT) AS n_correct, CAST(length(hallucinated_answer) AS INT) AS n_other FROM f WHERE first = 1""",
    "document_split": f"""WITH g AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), k AS (SELECT doc_id, row_number() OVER (ORDER BY {_H.format('doc_id', 7)}, doc_id) AS p, count(*) OVER () AS n FROM g)
        SELECT doc_id, CASE WHEN p <= round_even(n * 0.6::DOUBLE, 0) THEN 'dev' WHEN p <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS part FROM documents LEFT JOIN k USING (doc_id)""",
    "conversation_folds": f"""WITH g AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), k AS (SELECT conv_id, CAST(ntile(5) OVER (ORDER BY {_H.format('conv_id', 500)}, conv_id) - 1 AS INT) AS fold FROM g)
        SELECT conv_id, turn, fold FROM conversations LEFT JOIN k USING (conv_id)""",
    "class_balanced": f"""WITH c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)),
        s AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_H.format('vec_id', 3)}, vec_id) AS p FROM embeddings)
        SELECT vec_id, label FROM s JOIN c USING (label) WHERE p <= 103 // k + CASE WHEN i < 103 % k THEN 1 ELSE 0 END""",
    "length_matched": f"WITH {_KINDS}, k AS (SELECT *, row_number() OVER (PARTITION BY kind, bin ORDER BY n_chars, doc_id) AS p FROM b) SELECT doc_id, kind, bin FROM k JOIN q USING (bin) WHERE p <= quota",
    "length_matched_sample": f"""WITH {_KINDS}, s AS (SELECT bin, quota, sum(quota) OVER () AS total, quota * least(40, sum(quota) OVER ())::DOUBLE / sum(quota) OVER () AS scaled FROM q),
        f AS (SELECT bin, floor(scaled) AS base, least(40, total) - sum(floor(scaled)) OVER () AS more, row_number() OVER (ORDER BY floor(scaled) - scaled, bin) AS o FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY kind, bin ORDER BY {_H.format('doc_id', 11)}, doc_id) AS p FROM b)
        SELECT doc_id, kind, bin FROM k JOIN f USING (bin) WHERE p <= base + CASE WHEN o <= more THEN 1 ELSE 0 END""",
    "alpha_replacement": f"""WITH t AS (SELECT a.vec_id AS pid, a.embedding[1]::DOUBLE AS x, b.embedding[1]::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
        k AS (SELECT *, row_number() OVER (ORDER BY {_H.format('pid', 5)}, pid) <= round_even(0.25::DOUBLE * count(*) OVER (), 0) AS replaced FROM t) SELECT pid, CASE WHEN replaced THEN y ELSE x END AS x, replaced FROM k""",
    "shuffled_labels": f"""WITH l AS (SELECT * FROM labels WHERE doc_id IS NOT NULL), a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM l), b AS (SELECT quality, row_number() OVER (ORDER BY {_H.format('doc_id', 2)}, doc_id) AS p FROM l)
        SELECT doc_id, quality FROM a JOIN b USING (p)""",
    "null_halves": f"""WITH a AS (SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) % 2 = 1 THEN 'P' ELSE 'Q' END AS side FROM embeddings),
        b AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {_H.format('vec_id', 4)}, vec_id) AS p FROM a) SELECT vec_id, side FROM b WHERE p <= 100""",
    "packets": f"""WITH {_KINDS}, s AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {_H.format('doc_id', 9)}, doc_id) AS p FROM d),
        c AS (SELECT p - 8 AS pid, doc_id FROM s WHERE kind = 'correct' AND p BETWEEN 9 AND 16), h AS (SELECT p AS pid, doc_id FROM s WHERE kind = 'hallucinated' AND p <= 8),
        m AS (SELECT c.pid, c.doc_id AS c, h.doc_id AS h, row_number() OVER (ORDER BY {_H.format('c.pid', 10)}, c.pid) <= 4 AS r FROM c JOIN h USING (pid))
        SELECT 'P' AS side, p AS position, kind, doc_id AS item FROM s WHERE kind = 'correct' AND p <= 8 UNION ALL SELECT 'Q', pid, CASE WHEN r THEN 'hallucinated' ELSE 'correct' END, CASE WHEN r THEN h ELSE c END FROM m""",
    "mode_reference": "SELECT CAST(i AS INT) AS mode, round(8 * cos(i * 2 * pi() / 8), 9) + 0.0::DOUBLE AS x, round(8 * sin(i * 2 * pi() / 8), 9) + 0.0::DOUBLE AS y FROM range(8) t(i)",
    "image_sweep": """WITH i AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor(v::DOUBLE * 64 + 128) AS INT)))) AS px FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        s(severity) AS (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)), m AS (SELECT *, list_avg(px) AS mean FROM i, s)
        SELECT image_id, severity, CAST(list_sum(list_transform(px, lambda v: CAST(trunc(greatest(0, least(255, v + 255.0::DOUBLE * severity))) AS BIGINT))) AS BIGINT) AS bright,
        CAST(list_sum(list_transform(px, lambda v: CAST(trunc(CASE WHEN severity = 0 THEN v ELSE greatest(0, least(255, mean + (v - mean) * (1.0::DOUBLE - severity))) END) AS BIGINT))) AS BIGINT) AS flat FROM m""",
    "turned_images": """WITH i AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor(v::DOUBLE * 64 + 128) AS INT)))) AS px FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        p AS (SELECT image_id, px, k, k // 8 AS y, k % 8 AS x FROM i, range(64) t(k)), a(angle) AS (VALUES (0.0::DOUBLE), (90.0::DOUBLE), (180.0::DOUBLE), (270.0::DOUBLE))
        SELECT image_id, angle, CAST(sum(k * px[CAST(CASE angle WHEN 0 THEN y * 8 + x WHEN 90 THEN x * 8 + 7 - y WHEN 180 THEN (7 - y) * 8 + 7 - x ELSE (7 - x) * 8 + y END + 1 AS INT)]) AS BIGINT) AS weighed FROM p, a GROUP BY 1, 2""",
    "strongest_component": """WITH m AS (SELECT label, i - 1 AS i, round(avg(embedding[i]::DOUBLE), 9) AS mean FROM embeddings, range(1, 65) t(i) WHERE embedding IS NOT NULL GROUP BY 1, 2)
        SELECT label, CAST(i AS INT) AS component, mean FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(mean) DESC, i) = 1""",
    "coerced_values": r"""WITH w AS (SELECT lang, unnest(string_split_regex(translate(text, '.,()', '    '), '[ \n]+')) AS word FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
        SELECT lang, count(*) AS n, count(TRY_CAST(CASE WHEN regexp_full_match(word, '[0-9]+') THEN word END AS INT)) AS numbers, CAST(sum(TRY_CAST(CASE WHEN regexp_full_match(word, '[0-9]+') THEN word END AS INT)) AS BIGINT) AS total
        FROM w WHERE regexp_full_match(word, '[0-9A-Za-z]{1,9}') GROUP BY 1""",
    "share_of_largest": "SELECT doc_id, source, round(n_chars / max(n_chars) OVER (PARTITION BY source), 9) AS share FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL AND source IS NOT NULL",
    "largest_duplicate_groups": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, first_doc LIMIT 10",
    "size_deciles": "SELECT lang, " + ", ".join(f"list_sort(list(n_chars::DOUBLE))[CAST(floor((count(*) - 1) * {q / 100}::DOUBLE) AS INT) + 1] AS p{q}" for q in range(10, 100, 10)) + " FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL GROUP BY 1",
    "csv_round_trip": "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE doc_id IS NOT NULL",
    "grid_run": """SELECT 'synthetic' AS experiment_family, CASE WHEN i = 0.75 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n,
        round(sum(CASE WHEN i <> 0.75 THEN d + k END), 6) AS mmd, 0::BIGINT AS n_js, 0 AS "left"
        FROM (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) a(d), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) b(i), range(10) r(k) GROUP BY 1, 2""",
    "experiment_grid": grids.sql(every_family(), list(store.CONFIG), store.DEFAULTS),
    "parsed_ids": """WITH t AS (SELECT experiment_id, string_split(experiment_id, '/') AS p FROM ({ids}))
        SELECT experiment_id, p[1] AS family, CAST(p[2] AS INT) AS layer, CASE p[1] WHEN 'l3' THEN 'direct' WHEN 'l3d' THEN 'length_matched' WHEN 'l3e' THEN 'shuffled' END AS mode,
        CASE WHEN p[1] LIKE 'l4%' THEN CAST(substr(p[3], 2) AS DOUBLE) END AS alpha, CAST(substr(p[len(p)], 2) AS INT) AS repeat FROM t""".format(ids=grids.sql(grids.mixtures(*_MIXTURES), list(store.CONFIG), store.DEFAULTS)),
    "parsed_grid_ids": """WITH t AS (SELECT experiment_id, experiment_family AS family, string_split(experiment_id, '/') AS p FROM ({ids}))
        SELECT experiment_id, family, p[2] AS space, CASE WHEN p[1] IN ('c1a', 'c1b') THEN substr(p[3], 2) END AS level, CASE WHEN p[1] = 'c2r' THEN p[3] END AS comparison,
        CASE WHEN p[1] = 'c2s' THEN substr(p[3], 2) END AS angle, substr(p[len(p)], 2) AS repeat FROM t""".format(ids=grids.sql([f for g in ("c0", "c1", "c2r", "c2s") for f in grids.GRIDS[g]], list(store.CONFIG), store.DEFAULTS)),
    "incremental_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        canonical_pairs, audit_pairs, document_split, conversation_folds, class_balanced, length_matched, length_matched_sample, alpha_replacement, shuffled_labels, null_halves, packets,
        mode_reference, generated_clouds, image_sweep, turned_images, strongest_component, coerced_values, share_of_largest, largest_duplicate_groups, size_deciles, csv_round_trip, experiment_grid, parsed_ids, parsed_grid_ids, grid_run, incremental_counts,
    )
}
