"""Long runs in blocks: finished blocks are kept, broken ones done anew, other parameters and a second writer refused.

Every block is a folder ``<key>=<value>/...`` of its own, overwritten as a whole, and counts as finished once Spark's commit has left its
mark there.  Parameters lie beside the blocks.  A writer holds a claim file that only one can create.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ParametersDiffer(ValueError):
    """The stored blocks were computed with other parameters."""


class AlreadyClaimed(RuntimeError):
    """Another writer holds the run."""


class CacheMismatch(ValueError):
    """A table isn't what its manifest, or its reader, says."""


class Files:
    """Small files in whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))

    def write(self, name: str, text: str, overwrite: bool) -> None:
        """Raises where the file is there already, unless it may be overwritten; of several creators one succeeds."""
        out = self.fs.create(self._path(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        lines = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return lines[0].value if lines else ""

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class BlockRun:
    """A run of blocks named by the values of ``keys``.  As a context it holds the claim; reading needs none.

    Parameters that differ from those stored are an error once a block is finished; before that they take their place.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], params: dict):
        self.spark, self.path, self.keys, self.params = spark, path.rstrip("/"), keys, params
        self.files, self.claim = Files(spark, path), None

    def __enter__(self) -> BlockRun:
        mine = uuid.uuid4().hex
        try:
            self.files.write("claim", mine, overwrite=False)
        except Exception as e:
            raise AlreadyClaimed(f"{self.path} is being written by another run; delete its claim if that one is gone") from e
        self.claim = mine
        try:
            self._settle_parameters()
        except BaseException:
            self.__exit__()
            raise
        return self

    def __exit__(self, *_) -> None:
        if self.claim and self.files.exists("claim") and self.files.read("claim") == self.claim:
            self.files.delete("claim")
        self.claim = None

    def _settle_parameters(self) -> None:
        now = json.dumps(self.params, sort_keys=True, allow_nan=False)
        if self.files.exists("params.json"):
            before = self.files.read("params.json")
            if before == now:
                return
            if self._any_finished():
                old = json.loads(before)
                differ = sorted(k for k in {*old, *self.params} if old.get(k) != self.params.get(k))
                raise ParametersDiffer(f"{', '.join(f'{k}: stored {old.get(k)!r}, now {self.params.get(k)!r}' for k in differ)}; take another folder")
        self.files.write("params.json", now, overwrite=True)

    def _folder(self, block: dict) -> str:
        return "blocks/" + "/".join(f"{k}={block[k]}" for k in self.keys)

    def _any_finished(self) -> bool:
        pattern = self.files._path("blocks/" + "/".join(["*"] * len(self.keys)) + "/_SUCCESS")
        return len(self.files.fs.globStatus(pattern) or []) > 0

    def finished(self, block: dict) -> bool:
        return self.files.exists(f"{self._folder(block)}/_SUCCESS")

    def run(self, blocks: Iterable[dict], compute: Callable[[dict], DataFrame]) -> list[dict]:
        """Writes ``compute(block)`` for every block that isn't finished; a block that fails leaves its message and stops no other.
        Returns a dict (keys, status: kept, ok or failed, error) for each."""
        if not self.claim:
            raise AlreadyClaimed("a run is written inside its context only")
        out = []
        for block in blocks:
            named = {k: block[k] for k in self.keys}
            if self.finished(block):
                out.append(named | {"status": "kept", "error": None})
                continue
            try:
                compute(block).drop(*self.keys).write.mode("overwrite").parquet(f"{self.path}/{self._folder(block)}")
                out.append(named | {"status": "ok", "error": None})
            except Exception as e:  # the next block may do well
                self.files.delete(self._folder(block))
                out.append(named | {"status": "failed", "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"})
        return out

    def frame(self, schema: str) -> DataFrame:
        """The rows of all finished blocks; ``schema`` names their columns, the keys included."""
        if not self._any_finished():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/blocks")


def checked_cache(rows: DataFrame, manifest: dict, expect: dict | None = None, item: str = "item_id", layer: str = "layer_index", vector: str = "x") -> DataFrame:
    """``rows`` (a row for each item and layer) if they are what ``manifest`` says and the manifest what ``expect`` asks; else an error that
    names the field, what was expected and what is there.

    Checked are n_items, layer_indices where given, a row for every item in every layer, and one length of vectors.
    """
    for field, wanted in (expect or {}).items():
        if field not in manifest:
            raise CacheMismatch(f"{field}: expected {wanted!r}, the manifest has no such field")
        if manifest[field] != wanted:
            raise CacheMismatch(f"{field}: expected {wanted!r}, the manifest has {manifest[field]!r}")
    if "n_items" not in manifest:
        raise CacheMismatch("n_items: the manifest has no such field, so nothing can be checked")
    cells = rows.groupBy(item, layer).agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most"))
    by_layer = cells.groupBy(layer).agg(F.count("*").alias("items"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    layers = sorted(r[layer] for r in by_layer)
    wanted = sorted(manifest.get("layer_indices", layers))
    if layers != wanted:
        raise CacheMismatch(f"layer_indices: expected {wanted!r}, the rows have {layers!r}")
    for r in by_layer or [None]:
        have = r["items"] if r else 0
        if have != manifest["n_items"]:
            raise CacheMismatch(f"n_items: expected {manifest['n_items']!r}, layer {r[layer] if r else None!r} has {have!r}")
        if r and r["n"] != have:
            raise CacheMismatch(f"rows: expected {have!r} in layer {r[layer]!r}, there are {r['n']!r}")
    if len({r[k] for r in by_layer for k in ("least", "most")}) > 1:
        raise CacheMismatch("vectors: expected one length, there are several")
    return rows
