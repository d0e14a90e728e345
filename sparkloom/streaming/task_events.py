"""Task events as a stream: the same results as over a table, kept up to date while events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "run_id string, seq long, task string, status string, attempts int, error string, duration double, reason string, ts timestamp"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, max_files: int = 1000) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def status_counts(events: DataFrame, *, window: str = "5 minutes", late: str = "10 minutes", ts_col: str = "ts", status_col: str = "status") -> DataFrame:
    """Events by status and time window; a window is final once the watermark has passed it."""
    stamped = events.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", late)
    counted = stamped.groupBy(F.window("_ts", window), F.col(status_col).alias("status")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "status", "n")


def without_repeats(events: DataFrame, keys: list[str], *, late: str = "10 minutes", ts_col: str = "ts") -> DataFrame:
    """Events that were delivered more than once, once; state goes with the watermark."""
    return events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, *, key_col: str, gap: str = "30 minutes", late: str = "10 minutes", ts_col: str = "ts") -> DataFrame:
    """Bursts of events of each key, ended by a gap."""
    stamped = events.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", late)
    grouped = stamped.groupBy(F.col(key_col).alias("key"), F.session_window("_ts", gap)).agg(F.count("*").alias("n"))
    return grouped.select("key", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each task, for a stream in complete or update mode: a max over (seq, status)."""
    return events.groupBy("run_id", "task").agg(F.max(F.struct("seq", "status", "attempts")).alias("e")).select("run_id", "task", "e.status", "e.attempts")
