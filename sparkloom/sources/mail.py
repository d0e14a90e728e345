"""A mail archive: ``.eml`` files read and parsed on the executors, and kept as a table of one row for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.mime import parse_message
from sparkloom.operators.relational import import_delta, surrogate_id, upsert_latest

PARSED = "subject string, sender string, recipients string, date string, date_parsed string, body_text string, body_html string, has_attachments int"
EMAILS = (
    "id long, file_path string, file_hash string, subject string, sender string, recipients string, date string, date_parsed string, "
    "body_text string, body_html string, has_attachments int, file_size long, created_at timestamp, updated_at timestamp"
)
LISTED = ["id", "subject", "sender", "recipients", "date", "has_attachments"]


def read_files(spark: SparkSession, folder: str, glob: str = "*.eml") -> DataFrame:
    """(file_path, content, file_size) of all files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("path").alias("file_path"), "content", F.col("length").alias("file_size"))


def parse_mails(files: DataFrame) -> DataFrame:
    """The eleven fields of each mail; hash and size stay in the JVM. A file that is no mail gives empty fields."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = pd.DataFrame([parse_message(bytes(c or b"")) for c in rows.content], columns=[f.split()[0] for f in PARSED.split(", ")])
            yield pd.concat([rows[["file_path", "file_hash", "file_size"]].reset_index(drop=True), made], axis=1)

    hashed = files.select("file_path", F.md5("content").alias("file_hash"), "file_size", "content")
    return hashed.mapInPandas(parse, "file_path string, file_hash string, file_size long, " + PARSED)


def import_mails(spark: SparkSession, folder: str, stored: DataFrame, now: Column | None = None) -> DataFrame:
    """The archive after an import: new and changed files are parsed and replace what was stored under their path.

    Files are hashed first, and only those that are new or changed are parsed. Rows of files that vanished stay.
    """
    files = read_files(spark, folder)
    now = F.current_timestamp() if now is None else now
    changed = import_delta(files.withColumn("file_hash", F.md5("content")), stored, "file_path", "file_hash")
    parsed = parse_mails(changed.select("file_path", "content", "file_size"))
    rows = parsed.withColumns({"id": surrogate_id("file_path", "file_hash"), "created_at": now, "updated_at": now})
    columns = [f.split()[0] for f in EMAILS.split(", ")]
    return upsert_latest(stored.select(columns), rows.select(columns), ["file_path"], "updated_at")


def empty_archive(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMAILS)


def list_view(emails: DataFrame) -> DataFrame:
    """The columns of the list; Parquet reads no others."""
    return emails.select(LISTED)
