"""The quality rule's threshold and its errors on labelled documents."""

import numpy as np
from pyspark.sql import functions as F

from nubes.llm import quality

DATA = "/root/testdata/sf0.01"


def test_the_cut_has_the_least_error():
    cut = lambda rows: quality.best_cut(*np.array(rows, np.int64).T)
    assert cut([(-300, 0, 5), (-200, 0, 5), (-100, 4, 0), (50, 9, 0)]) == -149 / 1024
    assert cut([(-30, 1, 5), (-20, 0, 5), (-10, 9, 1)]) == -14 / 1024
    assert cut([(5, 3, 0)]) == quality.THRESHOLD


def test_both_errors_on_labelled_documents_are_small(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where("NOT base_failed")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kept = {r.quality: r.kept for r in rows.join(known, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] >= 0.97 and kept[0] <= 0.05
