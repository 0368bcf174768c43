"""Incremental runs: new files only, each batch committed once, the aggregate kept in a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.plans.scratch import Scratch


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """(hour, event_type, n, total) of a Parquet table read as a stream.

    Every micro-batch writes its partial sums under its own batch number, so a batch that is run again after a failure
    overwrites itself; the result adds the partial sums up.  Rows without a time are left out.
    """
    scratch = Scratch(spark, "stream")
    schema = spark.read.parquet(path).schema

    def commit(batch: DataFrame, number: int) -> None:
        sums = batch.where("ts IS NOT NULL").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(scratch.path(f"sums/batch={number}"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path if path.endswith("/") else path + "*")
    query = stream.writeStream.foreachBatch(commit).trigger(availableNow=True).option("checkpointLocation", scratch.path("state")).start()
    query.awaitTermination()
    parts = spark.read.schema("hour timestamp, event_type string, n long, total double").parquet(scratch.path("sums/*"))
    return parts.groupBy("hour", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))
