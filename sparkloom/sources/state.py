"""Stored results of steps: a Parquet table for each key, and a manifest of rows that say which one is current."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import StateError
from sparkloom.operators.dispatch import live_state

MANIFEST = "key string, path string, ts double"


class TableState:
    """State in a folder that driver and executors share.

    ``save`` writes a result under a path of its own; it counts from the ``commit`` on that appends its row to the
    manifest, once for all results of a run. A run that dies before leaves the old state as it was. ``ttl`` is in
    seconds; an entry exactly that old still counts.
    """

    def __init__(self, spark: SparkSession, folder: str, ttl: float | None = None) -> None:
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl
        self._pending: list[tuple[str, str, float]] = []

    def manifest(self) -> DataFrame:
        """The newest entry of each key that hasn't expired."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
            if not {"key", "path", "ts"} <= set(self.spark.read.parquet(f"{self.folder}/manifest").columns):
                raise StateError(f"{self.folder}/manifest is no manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return self.spark.createDataFrame([], MANIFEST)
            raise StateError(f"{self.folder}/manifest can't be read") from e
        newest = rows.groupBy("key").agg(F.max(F.struct("ts", "path")).alias("n")).select("key", "n.path", "n.ts").where("path <> ''")
        return live_state(newest, F.lit(time.time()), self.ttl)

    def load(self, key: str) -> DataFrame | None:
        found = self.manifest().where(F.col("key") == key).first()
        return None if found is None else self.spark.read.parquet(found["path"])

    def save(self, key: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/tables/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._pending.append((key, path, time.time()))
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self) -> None:
        if self._pending:
            self.spark.createDataFrame(self._pending, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
            self._pending = []

    def clear(self) -> None:
        """Forget all results: an entry without a path hides those before it."""
        now = time.time()
        self._pending = [(r["key"], "", now) for r in self.manifest().select("key").toLocalIterator()]
        self.commit()


class SessionState:
    """State for as long as the session lives: persisted DataFrames."""

    def __init__(self, ttl: float | None = None) -> None:
        self.ttl, self._held = ttl, {}

    def load(self, key: str) -> DataFrame | None:
        found = self._held.get(key)
        return None if found is None or self.ttl is not None and time.monotonic() - found[1] > self.ttl else found[0]

    def save(self, key: str, df: DataFrame) -> DataFrame:
        self._held[key] = (df.persist(), time.monotonic())
        return self._held[key][0]

    def commit(self) -> None:
        """Nothing to do: entries count at once."""

    def clear(self) -> None:
        for df, _ in self._held.values():
            df.unpersist()
        self._held = {}
