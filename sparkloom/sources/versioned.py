"""Tables that are merged into, in numbered versions: rows in buckets by a hash of their keys, and a list of current folders.

An upsert rewrites only the buckets that its keys fall in, under a new folder; the next version's file then lists these in
place of the old ones. That file is created exclusively, so of two writers one gets the number; the other takes up the
newer version and, unless that has changed one of its buckets, only publishes its folders again. A run that dies before
leaves folders that no version lists: the table is as it was, and ``vacuum`` removes them. Readers of a version see it whole.

What the driver holds is a path for each bucket. Choose as many buckets as make one some hundred MB.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import StateError
from sparkloom.operators.relational import last_per_key
from sparkloom.session import scope, written


class VersionedTable:
    """A table in a folder that driver and executors share, with unique ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets

    def _path(self, at: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _names(self, at: str) -> list[str]:
        fs = self._path(at).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(at))) if fs.exists(self._path(at)) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``schema`` and, for each bucket that has rows, the ``folders`` they are in; 0 before the first version."""
        there = self.versions()
        if not there and version in (None, 0):
            return {"version": 0, "schema": None, "folders": {}}
        version = there[-1] if version is None else version
        if version not in there:
            raise StateError(f"{self.folder} has no version {version}")
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{version:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> bool:
        """Create a version's file; False if another writer was first."""
        at = self._path(f"{self.folder}/versions/{manifest['version']:012d}.json")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame | None:
        paths = [p for b, p in sorted(manifest["folders"].items()) if buckets is None or int(b) in set(buckets)]
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        made = self._read(self.manifest(version))
        if made is None:
            raise StateError(f"{self.folder} has no version")
        return made

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows with these keys; only their buckets are read."""
        wanted = [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]
        return self._read(self.manifest(version), wanted).join(keys.select(self.keys).distinct(), self.keys, "left_semi")

    def _change(self, rows: DataFrame, merge: Callable[[DataFrame | None], DataFrame]) -> int:
        """Put ``merge`` of the touched buckets in their place; the new version's number."""
        touched = [r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # no more than there are buckets
        base, made = self.manifest(), None
        if not touched:
            return base["version"]
        while True:
            if made is None:
                merged, name = merge(self._read(base, touched)), f"data/{uuid.uuid4().hex}"
                merged.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
                made = {n.removeprefix("bucket="): f"{name}/{n}" for n in self._names(f"{self.folder}/{name}") if n.startswith("bucket=")}
                schema = base["schema"] or merged.schema.json()
            kept = {b: p for b, p in base["folders"].items() if int(b) not in touched}
            if self._publish({"version": base["version"] + 1, "schema": schema, "folders": kept | made}):
                return base["version"] + 1
            newer = self.manifest()
            if any(newer["folders"].get(str(b)) != base["folders"].get(str(b)) for b in touched):
                made = None  # what was merged has changed
            base = newer

    def upsert(self, incoming: DataFrame, seq_col: str) -> int:
        """Put rows in: of those with one key, old or new, the one with the highest ``seq_col`` stays. The new version's number."""
        with scope():
            held = written(incoming, "incoming")
            columns = held.columns
            both = lambda old: held if old is None else old.select(columns).unionByName(held)
            return self._change(held, lambda old: last_per_key(both(old), self.keys, [F.col(seq_col)]))

    def delete(self, keys: DataFrame) -> int:
        with scope():
            held = written(keys.select(self.keys).distinct(), "deleted")
            return self._change(held, lambda old: old.join(held, self.keys, "left_anti")) if self.versions() else 0

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the newest ``keep`` versions, and the folders that no version left lists. No writer may be at work."""
        there = self.versions()
        listed = {p.rpartition("/")[0] for v in there[-keep:] for p in self.manifest(v)["folders"].values()}
        gone = [f"versions/{v:012d}.json" for v in there[:-keep]] + [f"data/{n}" for n in self._names(f"{self.folder}/data") if f"data/{n}" not in listed]
        for name in gone:
            at = self._path(f"{self.folder}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return gone
