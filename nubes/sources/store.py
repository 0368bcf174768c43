"""A keyed, resumable store of experiment results on Parquet, and the grid runner that fills it."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.sources import grids
from nubes.sources.block_runs import AlreadyClaimed, Files

# The columns of the result format.
CONFIG = {
    "experiment_id": "string", "experiment_family": "string", "dataset": "string", "model": "string", "model_revision": "string", "representation": "string", "layer": "long",
    "pooling": "string", "pca_dim": "long", "normalization": "string", "n_P": "long", "n_Q": "long", "alpha": "double", "drop_fraction": "double", "invent_fraction": "double",
    "corruption": "string", "severity": "double", "seed": "long", "split_id": "string", "prompt_ids_hash": "string", "metric_params": "string",
}
METRICS = ["mtd_PQ", "mtd_QP", "ntd_PQ", "ntd_QP", "rtd", "precision@1", "recall@1", "precision@3", "recall@3", "precision@10", "recall@10", "mmd", "frechet", "js"]
SCHEMA = ", ".join([*(f"{c} {t}" for c, t in CONFIG.items()), *(f"`{m}` double" for m in METRICS), "runtime_seconds double", "status string", "error_message string", "config_key string"])
KEY_LENGTH = 16
DEFAULTS = {"model": "", "representation": "", "n_P": 0, "n_Q": 0}


def full_config(config: dict) -> dict:
    """All config columns; absent and null ones get their default."""
    return {c: DEFAULTS.get(c) if config.get(c) is None else config[c] for c in CONFIG}


def config_key(config: dict) -> str:
    """The first hex digits of SHA-256 over the canonical JSON of all config columns; absent ones are null, NaN is an error."""
    text = json.dumps(full_config(config), sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()[:KEY_LENGTH]


def result_row(config: dict, metrics: dict | None, seconds: float, error: str | None = None) -> dict:
    """A row of the store; a metric that the format doesn't know is an error, NaN becomes null."""
    unknown = set(metrics or {}) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    values = {m: (None if (v := (metrics or {}).get(m)) is None or math.isnan(v) else float(v)) for m in METRICS}
    return full_config(config) | values | {"runtime_seconds": seconds, "status": "failed" if error else "ok", "error_message": error, "config_key": config_key(config)}


class ResultStore:
    """Rows keyed by config_key in one Parquet folder per write; a replaced key's newest batch counts.

    Nothing is rewritten on append, so n appends cost n, and a failed write leaves no half row (Spark commits a batch whole).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(fs.exists(p)) and len(fs.listStatus(p)) > 0

    def frame(self) -> DataFrame:
        """The current rows: of each key those of its last batch."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA + ", batch long").parquet(self.path)
        last = rows.groupBy("config_key").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["config_key", "batch"]).select(*self.spark.createDataFrame([], SCHEMA).columns)

    @contextmanager
    def _claimed(self):
        """Checks and the write they allow happen under a claim file that one writer at a time can create."""
        files = Files(self.spark, self.path)
        try:
            files.write("_claim", "", overwrite=False)
        except Exception as e:
            raise AlreadyClaimed(f"{self.path} is being written; delete its _claim if that writer is gone") from e
        try:
            yield
        finally:
            files.delete("_claim")

    def _write(self, rows: DataFrame) -> None:
        """A batch is numbered above all that its writer can see, so a clock that goes back reorders nothing."""
        seen = self.spark.read.schema(SCHEMA + ", batch long").parquet(self.path).agg(F.max("batch")).first()[0] if self._exists() else None
        rows.withColumn("batch", F.lit(max(time.time_ns(), (seen or 0) + 1))).write.mode("append").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Adds rows; a key that is stored already, or twice among them, is an error."""
        with self._claimed():
            if not rows.groupBy("config_key").count().where("count > 1").isEmpty() or not rows.join(self.frame(), "config_key", "left_semi").isEmpty():
                raise ValueError("a config_key occurs twice")
            self._write(rows)

    def replace(self, rows: DataFrame) -> None:
        """Adds rows in place of those with the same keys."""
        if not rows.groupBy("config_key").count().where("count > 1").isEmpty():
            raise ValueError("a config_key occurs twice")
        with self._claimed():
            self._write(rows)

    def missing(self, configs: DataFrame, retry_failed: bool = False) -> DataFrame:
        """The configs (with config_key) that have no row, or a failed one if ``retry_failed``."""
        done = self.frame() if not retry_failed else self.frame().where("status = 'ok'")
        return configs.join(done.select("config_key"), "config_key", "left_anti")

    def manifest(self) -> dict:
        """Row and key counts and a digest of the keys; taken from the rows, so it can't disagree with them."""
        rows = self.frame()
        r = rows.agg(F.count("*").alias("n"), F.countDistinct("config_key").alias("k"), F.count_if(F.col("status") == "failed").alias("f"), F.coalesce(F.sum(F.xxhash64("config_key").cast("decimal(38,0)")), F.lit(0)).alias("d")).first()
        return {"rows": r.n, "keys": r.k, "failed": r.f, "digest": str(r.d), "created": datetime.now(timezone.utc).isoformat()}

    def broken_keys(self) -> DataFrame:
        """Rows whose key isn't that of their config columns."""
        return with_keys(self.frame().drop("config_key")).join(self.frame().select("config_key"), "config_key", "left_anti")


def with_keys(configs: DataFrame) -> DataFrame:
    """``configs`` with config_key, hashed in Arrow batches."""

    @F.pandas_udf("string")
    def key(c: pd.DataFrame) -> pd.Series:
        clean = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
        whole = {n for n, t in CONFIG.items() if t == "long"}
        out = []
        for row in c.to_dict("records"):
            row = {k: clean(v) for k, v in row.items()}
            out.append(config_key({k: int(v) if k in whole and v is not None else v for k, v in row.items()}))
        return pd.Series(out)

    return configs.withColumn("config_key", key(F.struct(*(F.col(f"`{c}`") if c in configs.columns else F.lit(None).cast(t).alias(c) for c, t in CONFIG.items()))))


def configs_frame(spark: SparkSession, configs: list[dict]) -> DataFrame:
    rows = [full_config(c) | {"config_key": config_key(c)} for c in configs]
    return spark.createDataFrame([tuple(r[k] for k in [*CONFIG, "config_key"]) for r in rows], ", ".join(f"{c} {t}" for c, t in CONFIG.items()) + ", config_key string")


def run_grid(store: ResultStore, configs: DataFrame, runner: Callable[[dict], dict], retry_failed: bool = False) -> int:
    """``runner(config) -> metrics`` for every config without a result, one task each; how many ran.

    An error of one config becomes a failed row and stops no other.  Run again, it goes on where it was.
    """
    todo = store.missing(configs, retry_failed)
    n = todo.count()

    def run(frames):
        for f in frames:
            out = []
            for config in f.drop(columns="config_key").astype(object).where(f.drop(columns="config_key").notna(), None).to_dict("records"):
                config = {k: int(v) if CONFIG[k] == "long" and v is not None else v for k, v in config.items()}
                began = time.time()
                try:
                    out.append(result_row(config, runner(config), time.time() - began))
                except Exception as e:  # the row says what went wrong
                    out.append(result_row(config, None, time.time() - began, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out)

    if n:
        store.replace(todo.select(*CONFIG, "config_key").repartition(min(n, 1000)).mapInPandas(run, SCHEMA))
    return n


def configs_of(families: list[grids.Family]) -> list[dict]:
    return [c for family in families for c in family.configs()]


def floor_configs() -> list[dict]:
    """Floors by sample size: 3 laws, 3 sizes, copy or same law, 5 repeats: 90."""
    return grids.S0.configs()


def drop_invent_configs() -> list[dict]:
    """Dropped by invented modes, 10 repeats: 160."""
    return grids.S3.configs()


def mixture_configs(layers, alphas, repeats: int, n_cloud: int = 500) -> list[dict]:
    return configs_of(grids.mixtures(layers, alphas, repeats, n_cloud))


def parse_ids(df: DataFrame, column: str = "experiment_id") -> DataFrame:
    """``df`` with family, layer, mode, alpha and repeat out of an id of ``mixture_configs``; any other id is an error."""
    c = F.col(column)
    pattern = r"^(?:(l3)/(\d+)/direct/r(\d+)|(l3d|l3e)/(\d+)/r(\d+)|(l4a|l4b)/(\d+)/a([0-9.e+-]+)/r(\d+))$"
    got = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    family = F.coalesce(got(1), got(4), got(7))
    checked = F.when(c.rlike(pattern), family).otherwise(F.raise_error(F.concat(F.lit("unknown experiment id: "), F.coalesce(c, F.lit("null")))).cast("string"))
    mode = F.when(family == "l3", "direct").when(family == "l3d", "length_matched").when(family == "l3e", "shuffled")
    layer, repeat = F.coalesce(got(2), got(5), got(8)).cast("int"), F.coalesce(got(3), got(6), got(10)).cast("int")
    return df.withColumns({"family": checked, "layer": layer, "mode": mode, "alpha": got(9).cast("double"), "repeat": repeat})
