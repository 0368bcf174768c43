"""Models over feature tables with explicit group folds, and the effect table with its normal tail."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.functions.statistics import detection_quality, is_similarity, spearman
from nubes.plans.scratch import Scratch

FOLDS = 5


def two_sided_p(z: str):
    """Twice the normal tail beyond |z| of a column; null for null."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else None)

    return tail(z)


def effect_table(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., metric, delta, z_mean, p_value): the effect's mean against the control's, over the control's standard error
    for as many repeats; positive is worse.  A control that doesn't vary gives null."""
    by = [*keys, "metric"]
    side = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("value")))
    g = values.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*by)
    g = g.agg(side("control", F.avg).alias("m0"), side("control", F.stddev_samp).alias("s0"), side("effect", F.avg).alias("m1"), side("effect", F.count).alias("n1"))
    sign = F.when(is_similarity(F.col("metric")), -1.0).otherwise(1.0)
    out = g.withColumn("delta", sign * (F.col("m1") - F.col("m0"))).withColumn("z_mean", F.when(F.col("s0") > 0, F.col("delta") / (F.col("s0") / F.sqrt("n1"))))
    return out.withColumn("p_value", two_sided_p("z_mean")).select(*by, "delta", "z_mean", "p_value")


def text_features(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, ...) with ``features`` and ``fold``: a fold by hash of the group, here the document."""
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).cast("double")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("double")
    rows = docs.withColumns({"words": words, "lines": lines, "chars": F.col("n_chars").cast("double"), "mean_word": F.col("n_chars") / F.greatest(words, F.lit(1.0))})
    rows = VectorAssembler(inputCols=["words", "lines", "chars", "mean_word"], outputCol="raw").transform(rows)
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))


def out_of_fold(rows: DataFrame, label: str, fit, score) -> DataFrame:
    """Rows with the score of the model fitted on all other folds; scaling is fitted there too.

    Every fold passes over the rows several times, so their figures are written once, without the texts that they come from.
    """
    scratch = Scratch(rows.sparkSession, "folds")
    rows = scratch.keep(rows.select("doc_id", label, "raw", "fold"), "rows")
    out = None
    for fold in range(FOLDS):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
        part = score(fit(scaler.transform(train)).transform(scaler.transform(test))).select("doc_id", F.col(label).cast("long").alias("label"), "score")
        out = part if out is None else out.unionAll(part)
    return scratch.keep(out, "scored")


def evaluate_detection(rows: DataFrame, label: str) -> DataFrame:
    """One row (auroc, auprc, balanced_accuracy) of out-of-fold probabilities; the penalty is that of C = 1."""
    n = rows.count()
    fit = lambda t: LogisticRegression(labelCol=label, regParam=1.0 / max(1, n * (FOLDS - 1) // FOLDS), standardization=False, maxIter=50).fit(t)
    scored = out_of_fold(rows, label, fit, lambda t: t.withColumn("score", F.round(vector_to_array("probability")[1], 9)))
    return detection_quality(scored.withColumn("all_", F.lit(0)), ["all_"], "score", "label", 0.5).drop("all_")


def evaluate_regression(rows: DataFrame, label: str) -> DataFrame:
    """One row (mae, r2, rho) of out-of-fold predictions of a ridge regression with penalty 1."""
    n = rows.count()
    fit = lambda t: LinearRegression(labelCol=label, regParam=1.0 / max(1, n * (FOLDS - 1) // FOLDS), standardization=False, solver="normal").fit(t)
    scored = out_of_fold(rows, label, fit, lambda t: t.withColumn("score", F.round("prediction", 9))).withColumn("all_", F.lit(0))
    gap = F.col("label") - F.col("score")
    plain = scored.groupBy("all_").agg(F.avg(F.abs(gap)).alias("mae"), (1 - F.sum(gap * gap) / F.nullif(F.var_pop("label") * F.count("*"), F.lit(0.0))).alias("r2"))
    return plain.join(spearman(scored, ["all_"], "label", "score"), "all_").select("mae", "r2", "rho")
