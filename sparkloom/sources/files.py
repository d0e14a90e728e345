"""Plain sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import requirement_name, requirement_version


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """(name, version) from text files of ``name==version`` lines; other lines are left out."""
    lines = spark.read.text(path)
    return lines.where(F.contains("value", F.lit("=="))).select(requirement_name(F.col("value")).alias("name"), requirement_version(F.col("value")).alias("version"))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modified, length) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def has_content(spark: SparkSession, path: str, text: str) -> bool:
    """Whether any line of the files at a path contains a text."""
    return not spark.read.text(path).where(F.contains("value", F.lit(text))).isEmpty()


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def delete_all(spark: SparkSession, path: str) -> None:
    """Leave a Parquet table without rows, its columns as they are."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
