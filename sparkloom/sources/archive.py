"""Mail archives of one file (mbox): read in byte ranges cut at message borders, and written.

In such a file each message follows a line ``From <envelope>`` and is followed by an empty line; lines of a message that
begin with ``From ``, after any number of ``>``, have one more ``>``. A text scan whose separator is such a border gives a
message a row: Spark cuts large files into ranges as it does for lines, on any file system, and reads no more than the rest
of the message that a range ends in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BYTES = "ISO-8859-1"  # a character for each byte: patterns leave all other bytes as they are


def _characters(content: Column) -> Column:
    return F.decode(content.cast("binary"), _BYTES)


def read_archive(spark: SparkSession, path: str, *, line_end: str = "\n", glob: str = "*") -> DataFrame:
    """(file_path, envelope, content, file_size) of each message below ``path``; ``file_size`` is that of its content.

    Envelopes are text (bytes that are no UTF-8 become U+FFFD). The content is bytes, without the line ends and empty lines
    that close a message, its own among them. Empty files hold none. Messages that are alike are rows of their own.
    """
    scan = spark.read.option("lineSep", f"{line_end}{line_end}From ").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    parts = scan.text(path).select(F.col("_metadata.file_path").alias("file_path"), _characters(F.col("value")).alias("part"))
    first = F.when(F.startswith("part", F.lit("From ")), F.expr("substring(part, 6)")).otherwise(F.col("part"))  # of a file
    whole = parts.select("file_path", F.rtrim(first, F.lit("\r\n")).alias("part")).where("part != ''")
    ends = F.locate(line_end, F.col("part"))
    head = F.when(ends > 0, F.expr("substring(part, 1, ends - 1)")).otherwise(F.col("part"))
    body = F.when(F.col("ends") > 0, F.expr(f"substring(part, ends + {len(line_end)})")).otherwise("")
    cut = whole.withColumn("ends", ends).select("file_path", head.alias("envelope"), body.alias("body"))
    content = F.encode(F.regexp_replace("body", r"(?dm)^>(>*From )", "$1"), _BYTES)
    return cut.select("file_path", F.make_valid_utf8(F.encode("envelope", _BYTES).cast("string")).alias("envelope"), content.alias("content")).withColumn("file_size", F.octet_length("content").cast("long"))


def write_archive(messages: DataFrame, path: str, *, envelope_col: str = "envelope", content_col: str = "content") -> None:
    """A file for each partition; null content is an empty message, a null or empty envelope ``-``. Line ends in envelopes become spaces."""
    envelope = F.regexp_replace(F.coalesce(F.nullif(F.col(envelope_col).cast("string"), F.lit("")), F.lit("-")), r"[\r\n]+", " ")
    body = F.regexp_replace(_characters(F.coalesce(F.col(content_col).cast("binary"), F.lit(b""))), r"(?dm)^(>*From )", ">$1")
    line = F.concat(F.lit("From "), _characters(envelope), F.lit("\n"), body, F.lit("\n"))
    messages.select(F.encode(line, _BYTES).cast("string").alias("value")).write.option("lineSep", "\n").text(path)
