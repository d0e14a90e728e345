"""Archives of many messages in one file: the same messages for any number of ranges."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparkloom.sources import archive, mail

BODIES = [
    b"Subject: one\n\nFrom here on\n>From there\nnot From this", b"", b"\n", b"ends with lines\n\n\n", b"\xff\xfe raw \xe9 bytes\r\nand \x85 more", "größer – 漢字".encode(),
    b"From \n\nFrom \n\n\nFrom x", b"same", b"same", b"x" * 5000, b"\n\n\n", b">>From twice\n>not\n> From",
]


def in_ranges(spark, path, size):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        made = archive.read_archive(spark, path)
        return made.rdd.getNumPartitions(), sorted((r["envelope"], bytes(r["content"]), r["file_size"]) for r in made.collect())
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("size", ["7", "64", "1000", "128m"])
def test_same_messages_in_any_ranges(spark, tmp_path, size):
    made = [(f"{k:03d}@example.org Mon", BODIES[k % len(BODIES)]) for k in range(40 if size == "7" else 300)]
    archive.write_archive(spark.createDataFrame(made, "envelope string, content binary").coalesce(1), f"{tmp_path}/box")
    parts, got = in_ranges(spark, f"{tmp_path}/box", size)
    bare = [(e, b.rstrip(b"\r\n")) for e, b in made]
    assert got == sorted((e, b, len(b)) for e, b in bare)
    assert parts > 3 or size == "128m"


def test_odd_archives(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "open").write_bytes(b"From a\nno empty line at the end")
    (tmp_path / "head").write_bytes(b"From only an envelope\n")
    got = archive.read_archive(spark, str(tmp_path)).selectExpr("envelope", "cast(content AS string)", "file_size")
    assert rows(got) == [("a", "no empty line at the end", 24), ("only an envelope", "", 0)]
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "x").write_bytes(b"From \xff\n\xfe\n\nFrom b\n\x85>From\n\n")
    got = archive.read_archive(spark, f"{tmp_path}/bytes")
    assert sorted((r["envelope"], bytes(r["content"])) for r in got.collect()) == [("b", b"\x85>From"), ("\ufffd", b"\xfe")]
    (tmp_path / "dos").mkdir()
    (tmp_path / "dos" / "x").write_bytes(b"From a\r\none\r\n\r\nFrom b\r\ntwo\r\n\r\n")
    got = archive.read_archive(spark, f"{tmp_path}/dos", line_end="\r\n").selectExpr("envelope", "cast(content AS string)", "file_size")
    assert rows(got) == [("a", "one", 3), ("b", "two", 3)]
    archive.write_archive(spark.createDataFrame([(None, None), ("a\nb", None)], "envelope string, content binary"), f"{tmp_path}/null")
    assert rows(archive.read_archive(spark, f"{tmp_path}/null").select("envelope", "file_size")) == [("-", 0), ("a b", 0)]


def test_messages_are_parsed(spark, tmp_path):
    made = [("k", f"Subject: number {k}\nFrom: a@example.org\n\nFrom the body of {k}\n".encode()) for k in range(20)]
    archive.write_archive(spark.createDataFrame(made, "envelope string, content binary"), f"{tmp_path}/box")
    parsed = mail.parse_mails(archive.read_archive(spark, f"{tmp_path}/box"))
    assert {r["subject"] for r in parsed.collect()} == {f"number {k}" for k in range(20)}
    assert parsed.where(F.col("body_text").startswith("From the body")).count() == 20
