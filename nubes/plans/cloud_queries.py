"""Queries over the cloud pair P (vectors with an even label) and Q (odd labels) of the table ``embeddings``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.operators import clouds, fused, rips, topology, transforms


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = embeddings(spark, sf_dir)
    return clouds.cloud(rows.where("label % 2 = 0"), "vec_id", "embedding"), clouds.cloud(rows.where("label % 2 = 1"), "vec_id", "embedding")


def r9(c: str) -> F.Column:
    return F.round(c, 9)


def precision_recall_at_k(spark, sf_dir):
    return clouds.precision_recall(*pair(spark, sf_dir)).select("k", r9("precision").alias("precision"), r9("recall").alias("recall"))


def knn_radii(spark, sf_dir):
    p, _ = pair(spark, sf_dir)
    return clouds.knn_radii(p, 3).select("pid", r9("radius").alias("radius"))


def coverage_mask(spark, sf_dir):
    p, q = pair(spark, sf_dir)
    centers = p.join(clouds.knn_radii(p, 3), "pid")
    return clouds.coverage(centers, q, ["radius"]).select("pid", F.col("radius").alias("covered"))


def mmd(spark, sf_dir):
    """gamma (1 / median squared of all pooled pairs) and the root of the unbiased squared discrepancy, 0 at least."""
    found = fused.pair_metrics(*pair(spark, sf_dir), mmd=True)
    return spark.createDataFrame([(round(found.gamma, 9), round(found.mmd, 9))], "gamma double, mmd double")


def energy_value(p: DataFrame, q: DataFrame) -> DataFrame:
    """2 mean d(P,Q) - mean d(P,P) - mean d(Q,Q), the zero diagonals included in the means."""
    n, m = p.count(), q.count()
    cross = clouds.pair_sums(clouds.pooled(p, q.limit(0)), clouds.pooled(p.limit(0), q), None, (n, m))
    mean = lambda rows, name: rows.select((F.col("d") / F.col("all")).alias(name))
    rows = mean(cross, "pq").crossJoin(F.broadcast(mean(clouds.pair_sums(p, None, None, (n, n)), "pp"))).crossJoin(F.broadcast(mean(clouds.pair_sums(q, None, None, (m, m)), "qq")))
    return rows.select((2 * F.col("pq") - F.col("pp") - F.col("qq")).alias("energy"), F.col("pp").alias("mean_distance_p"))


def energy_distance(spark, sf_dir):
    return energy_value(*pair(spark, sf_dir)).select(r9("energy").alias("energy"), r9("mean_distance_p").alias("mean_distance_p"))


def js_divergence(spark, sf_dir):
    return spark.createDataFrame([(round(fused.pair_metrics(*pair(spark, sf_dir), js_k=5).js, 9),)], "js double")


def nearest_to_q(spark, sf_dir):
    return clouds.smallest_distances(*pair(spark, sf_dir)).select("pid", r9("distance").alias("distance"))


def cloud_moments(spark, sf_dir):
    """Means and population covariances of both clouds: (side, i, j, mean_i, cov); the lower triangle."""
    rows = embeddings(spark, sf_dir).where("embedding IS NOT NULL AND vec_id IS NOT NULL")
    x = rows.select((F.col("label") % 2).alias("side"), F.col("embedding").cast("array<double>").alias("x"))
    # one row per pair of components: sums are partial in every task, so d * d numbers leave it
    cells = x.select("side", "x", F.posexplode("x").alias("i", "a")).select("side", "i", "a", F.posexplode("x").alias("j", "b")).where("j <= i")
    return cells.groupBy("side", "i", "j").agg(r9(F.avg("a")).alias("mean_i"), r9(F.covar_pop("a", "b")).alias("cov"))


def frechet_distance(spark, sf_dir):
    return spark.createDataFrame([(round(topology.frechet(*(clouds.moments(c) for c in pair(spark, sf_dir))), 9),)], "frechet double")


def linear_cka(spark, sf_dir):
    """CKA of the vectors with the vectors of the following id, row by row."""
    rows = clouds.cloud(embeddings(spark, sf_dir), "vec_id", "embedding")
    y = rows.select((F.col("pid") - 1).alias("pid"), F.col("x").alias("y"))
    return spark.createDataFrame([(round(topology.linear_cka(rows.join(y, "pid")), 9),)], "cka double")


def h0_barcode(spark, sf_dir):
    """Merges of single linkage over P: birth 0, death the length of a minimum spanning tree's edge; one endless bar."""
    p, _ = pair(spark, sf_dir)
    return topology.h0_bars(p).select(F.lit(0.0).alias("birth"), r9("death").alias("death"))


def bar_summary(spark, sf_dir):
    """B4 to B6 over the bars of P: count, total, longest finite, mean, and how many finite bars exceed 1."""
    p, _ = pair(spark, sf_dir)
    return topology.summarize(topology.h0_bars(p).withColumn("cloud", F.lit("p")), ["cloud"], 1.0)


def top_bars(spark, sf_dir):
    p, _ = pair(spark, sf_dir)
    bars = topology.h0_bars(p).where("death < double('inf')").withColumn("length", F.col("death") - F.col("birth"))
    return bars.orderBy(F.desc("length"), "birth").limit(5).select("birth", r9("death").alias("death"))


def mtd0(spark, sf_dir):
    return topology.mtd0(*pair(spark, sf_dir)).select(r9("mtd0").alias("mtd0"))


def ntd(spark, sf_dir):
    p, q = pair(spark, sf_dir)
    return topology.ntd(p, q, repeats=5, seed=42).select(r9("ntd").alias("ntd"))


def mtd(spark, sf_dir):
    return topology.mtd(*pair(spark, sf_dir)).select(r9("mtd_h0").alias("mtd_h0"), r9("mtd").alias("mtd"))


def rtd(spark, sf_dir):
    p, q = pair(spark, sf_dir)
    return topology.rtd(topology.paired(p, q), trials=5, batch=500, seed=42).select(r9("rtd").alias("rtd"))


def sinkhorn_cost(spark, sf_dir):
    return topology.sinkhorn(*pair(spark, sf_dir), most=500).select(F.round("cost", 6).alias("cost"))


def persistence_diagram(spark, sf_dir):
    """All H0 and H1 bars of P."""
    p, _ = pair(spark, sf_dir)
    return rips.whole_bars(p.withColumn("side", F.lit(1))).select(F.lit("p").alias("cloud"), "level", r9("birth").alias("birth"), r9("death").alias("death"))


def cross_barcode(spark, sf_dir):
    """All bars of the cross-barcode of P and Q."""
    return rips.cross_bars(*pair(spark, sf_dir)).select("level", r9("birth").alias("birth"), r9("death").alias("death"))


def pca_projection(spark, sf_dir):
    """P's first two principal axes applied to Q (fitted on one side only)."""
    p, q = pair(spark, sf_dir)
    model = transforms.pca_fit(p, 2)
    out = transforms.pca_transform(q, model)
    return out.select("pid", *(F.round(F.element_at("x", i), 6).alias(f"pc{i}") for i in (1, 2)))


def cloud_transforms(spark, sf_dir):
    """Translate, rotate, reflect, scale and stretch of the first two components of P, and the L2 norm after normalising."""
    p, _ = pair(spark, sf_dir)
    flat = p.select("pid", "x", F.slice("x", 1, 2).alias("v"))
    t = transforms
    v = F.col("v")
    parts = {"translated": t.translate(v, [1.0, -2.0]), "rotated": t.rotate(v, 30.0), "reflected": t.reflect(v, "x"), "scaled": t.scale(v, 3.0), "stretched": t.stretch(v, [2.0, 0.5])}
    cells = [r9(F.element_at(c, i)).alias(f"{name}_{i}") for name, c in parts.items() for i in (1, 2)]
    return flat.select("pid", *cells, r9(F.aggregate(t.normalize(F.col("x")), F.lit(0.0), lambda a, b: a + b * b)).alias("norm2"))


_P = "SELECT vec_id AS pid, embedding::DOUBLE[] AS x FROM embeddings WHERE label % 2 = 0 AND embedding IS NOT NULL"
_Q = _P.replace("= 0", "= 1")
_RADII = "SELECT a.pid, d AS radius FROM (SELECT a.pid, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY list_distance(a.x, b.x)) AS r FROM {c} a JOIN {c} b ON a.pid <> b.pid) a WHERE r = {k}"
_CELL = (
    "(SELECT avg(CAST(c AS INT)) FROM (SELECT q.pid, bool_or(list_distance(q.x, p.x) <= r.radius + 1e-12) AS c "
    "FROM {q} q, {p} p JOIN (" + _RADII + ") r ON r.pid = p.pid GROUP BY q.pid))"
)
_CTE = f"WITH p AS ({_P}), q AS ({_Q})"
_POOL = ", pool AS (SELECT pid * 2 AS pid, x FROM p UNION ALL SELECT pid * 2 + 1, x FROM q)"


def _entropy(c: str, k: int = 5, d: int = 64) -> str:
    volume = 0.5 * d * math.log(math.pi) - math.lgamma(0.5 * d + 1.0)
    harmonic = f"(SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) FROM {c})) t(i))"
    return f"({harmonic} - {sum(1.0 / i for i in range(1, k))!r}::DOUBLE + {volume!r}::DOUBLE + {d} * (SELECT avg(ln(greatest(radius, 1e-12::DOUBLE))) FROM ({_RADII.format(c=c, k=k)})))"


ORACLES = {
    "precision_recall_at_k": _CTE + " " + " UNION ALL ".join(
        f"SELECT {k} AS k, round({_CELL.format(q='q', p='p', c='p', k=k)}, 9) AS precision, round({_CELL.format(q='p', p='q', c='q', k=k)}, 9) AS recall" for k in (1, 3, 10)
    ),
    "knn_radii": f"{_CTE} SELECT pid, round(radius, 9) AS radius FROM ({_RADII.format(c='p', k=3)})",
    "coverage_mask": f"{_CTE} SELECT q.pid, bool_or(list_distance(q.x, p.x) <= r.radius + 1e-12) AS covered FROM q, p JOIN ({_RADII.format(c='p', k=3)}) r ON r.pid = p.pid GROUP BY q.pid",
    "mmd": f"""{_CTE}{_POOL}, g AS (SELECT 1.0::DOUBLE / greatest(median(list_distance(a.x, b.x)) ** 2, 1e-12::DOUBLE) AS gamma FROM pool a JOIN pool b ON a.pid < b.pid)
        SELECT round(gamma, 9) AS gamma, round(sqrt(greatest(0.0::DOUBLE,
          (SELECT avg(exp(-gamma * list_distance(a.x, b.x) ** 2)) FROM p a JOIN p b ON a.pid <> b.pid)
          + (SELECT avg(exp(-gamma * list_distance(a.x, b.x) ** 2)) FROM q a JOIN q b ON a.pid <> b.pid)
          - 2 * (SELECT avg(exp(-gamma * list_distance(a.x, b.x) ** 2)) FROM p a, q b))), 9) AS mmd FROM g""",
    "energy_distance": f"""{_CTE} SELECT round(2 * (SELECT avg(list_distance(a.x, b.x)) FROM p a, q b) - (SELECT avg(list_distance(a.x, b.x)) FROM p a, p b)
        - (SELECT avg(list_distance(a.x, b.x)) FROM q a, q b), 9) AS energy, round((SELECT avg(list_distance(a.x, b.x)) FROM p a, p b), 9) AS mean_distance_p""",
    "js_divergence": f"{_CTE}{_POOL} SELECT round(greatest(0.0::DOUBLE, {_entropy('pool')} - ({_entropy('p')} + {_entropy('q')}) / 2) / ln(2.0::DOUBLE), 9) AS js",
    "nearest_to_q": f"{_CTE} SELECT p.pid, round(min(list_distance(p.x, q.x)), 9) AS distance FROM p, q GROUP BY p.pid",
    "cloud_moments": """WITH e AS (SELECT vec_id, label % 2 AS side, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
        c AS (SELECT side, i - 1 AS i, j - 1 AS j, x[i] AS a, x[j] AS b FROM e, range(1, 65) t(i), range(1, 65) u(j) WHERE j <= i)
        SELECT side, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(avg(a), 9) AS mean_i, round(covar_pop(a, b), 9) AS cov FROM c GROUP BY 1, 2, 3""",
    "linear_cka": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
        m AS (SELECT a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
        v AS (SELECT i, j, covar_pop(x[i], x[j]) AS xx, covar_pop(y[i], y[j]) AS yy, covar_pop(y[i], x[j]) AS yx FROM m, range(1, 65) t(i), range(1, 65) u(j) GROUP BY i, j)
        SELECT round(sum(yx * yx) / (sqrt(sum(xx * xx)) * sqrt(sum(yy * yy))), 9) AS cka FROM v""",
    "cloud_transforms": f"""WITH p AS ({_P}), v AS (SELECT pid, x, x[1] AS a, x[2] AS b, radians(30.0::DOUBLE) AS t FROM p)
        SELECT pid, round(a + 1, 9) AS translated_1, round(b - 2, 9) AS translated_2, round(a * cos(t) - b * sin(t), 9) AS rotated_1, round(a * sin(t) + b * cos(t), 9) AS rotated_2,
        round(a, 9) AS reflected_1, round(-b, 9) AS reflected_2, round(3 * a, 9) AS scaled_1, round(3 * b, 9) AS scaled_2, round(2 * a, 9) AS stretched_1, round(0.5::DOUBLE * b, 9) AS stretched_2,
        1.0::DOUBLE AS norm2 FROM v""",
}

QUERIES = {
    f.__name__: f
    for f in (
        precision_recall_at_k, knn_radii, coverage_mask, mmd, energy_distance, js_divergence, nearest_to_q, cloud_moments, frechet_distance, linear_cka,
        h0_barcode, bar_summary, top_bars, mtd0, ntd, mtd, rtd, sinkhorn_cost, persistence_diagram, cross_barcode, pca_projection, cloud_transforms,
    )
}
