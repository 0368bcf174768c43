"""Intermediate tables in the folder that the whole cluster shares.

Iterative jobs cut their lineage by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back.  A lost
executor then costs a task, not the job, and the table is columnar and compressed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset and everything runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} intermediate tables need a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/nubes-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


class Scratch:
    """Tables of one operator call.

    ``keep`` writes a DataFrame and returns it re-read; ``drop`` deletes tables that no later step reads.  What a returned
    DataFrame still reads stays until the cluster clears the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(hadoop).delete(path, True)

    def drop_all_but(self, *names: str) -> None:
        """Deletes every table of this call but those named."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(hadoop)
        for status in fs.listStatus(root):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)
