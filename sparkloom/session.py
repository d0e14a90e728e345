"""What the library needs of a session: the shared folder, and tables written there to cut lineage.

Intermediate tables lie below ``<shared folder>/sparkloom-<application id>``. Those written within a ``scope`` go at its
end, ``remove`` takes a single one away, and what is left goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import NoSharedFolder

_BATCH_BYTES, _DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes = threading.local()
_known: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sparkloom")
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": False, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": False}
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master gets a temporary folder where that is unset: executors on other hosts couldn't read it.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        base = sc.getCheckpointDir()
    own = f"{base}/sparkloom-{sc.applicationId}"
    if own not in _known:
        _known.add(own)
        atexit.register(_delete, spark, own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone; the folder is scratch space
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs the running stage only, and later steps see real sizes instead of estimates.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _paths[made] = path
    for held in getattr(_scopes, "open", [])[-1:]:
        held.append((spark, path))
    return made


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A table without rows, made by the JVM alone: ``createDataFrame`` of a list starts Python workers on the executors."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def counted(df: DataFrame, label: str, which: Column | None = None) -> tuple[DataFrame, int]:
    """``written``, and how many rows there are, or how many of them ``which`` holds for: counted as they are written."""
    seen = Observation()
    made = written(df.observe(seen, (F.count("*") if which is None else F.count_if(which)).alias("n")), label)
    return made, seen.get["n"]


def gathered(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables of one schema that ``written`` made, as one scan: plans don't grow with their number."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[_paths[t] for t in tables])


def remove(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that no later action will read; other DataFrames are left alone."""
    for df in tables:
        if path := _paths.pop(df, None):
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end. Yields a function that keeps one, for the scope around this one; other DataFrames it leaves alone."""
    opened = _scopes.__dict__.setdefault("open", [])
    held: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_paths.get(df, ""))
        return df

    opened.append(held)
    try:
        yield keep
    finally:
        opened.pop()
        for spark, path in held:
            if path not in kept:
                _delete(spark, path)
            elif opened:
                opened[-1].append((spark, path))


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Spark cut Arrow batches for Python by bytes: rows may be long texts. A size that the session sets is kept."""
    if not spark.sparkContext.getConf().contains(_BATCH_BYTES) and spark.conf.get(_BATCH_BYTES) == _DEFAULT_BYTES:
        spark.conf.set(_BATCH_BYTES, size)
