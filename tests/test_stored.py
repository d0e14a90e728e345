"""The search index and versioned tables: what they read, write and keep."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparkloom.errors import StateError
from sparkloom.functions.text import contains_like
from sparkloom.sources import search_index
from sparkloom.sources.search_index import TextIndex
from sparkloom.sources.versioned import VersionedTable

TEXTS = ["Plain words here", "wörter ÜBER alles", "a\\b back", "100% sure", "a😀b x", "", None, "needle in the Hay_stack", "漢字かな交じり文", "Plain WORDS again"]


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = spark.createDataFrame([(k, TEXTS[k % 10] if k < 200 else f"filler {k} " * 5, k % 3) for k in range(400)], "id int, text string, x int")
    index = TextIndex(spark, str(tmp_path), "id", "text")
    index.add(docs.where("id % 2 = 0"), blocks=7)
    index.add(docs.where("id % 2 = 1"), blocks=7)
    assert index.search("xy").columns == ["id", "text", "x"]
    for keyword in ("words", "WORDS", "über", "a\\b", "100", "😀B", "xy", "%", "", "in%hay", "h_y", "字かな", "nowhere", "filler 35_ f"):
        assert rows(index.search(keyword)) == rows(docs.where(contains_like(F.col("text"), keyword))), keyword


def test_few_blocks_are_read_for_rare_words_and_deleted_ids_can_return(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"common text {'zebra' if k == 77 else ''} {k}") for k in range(300)], "id int, text string")
    index = TextIndex(spark, str(tmp_path), "id", "text")
    index.add(docs, blocks=20)
    assert len(index.blocks("zebra")) == 1 and len(index.blocks("common")) == 20 and index.blocks("no such") == [] and index.blocks("c") is None
    assert all("block=" in f for f in index.search("common").inputFiles()) and len(index.search("common").inputFiles()) >= 20
    scan = next(line for line in index.search("zebra")._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in scan and "block" in scan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert rows(index.search("zebra").select("id")) == [(77,)]
    index.delete(spark.createDataFrame([(77,), (5,)], "id int"))
    assert rows(index.search("zebra")) == [] and index.search("common").count() == 298
    index.add(spark.createDataFrame([(77, "zebra again")], "id int, text string"), blocks=1)
    assert rows(index.search("zebra")) == [(77, "zebra again")]
    with pytest.raises(FileNotFoundError):
        TextIndex(spark, f"{tmp_path}/none", "id", "text").search("x")


KEYED = "k int, name string, seq int"


def table_of(spark, path, n=200, buckets=16):
    made = VersionedTable(spark, str(path), ["k"], buckets)
    made.upsert(spark.createDataFrame([(k, "old", 1) for k in range(n)], KEYED), "seq")
    return made


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    made = table_of(spark, tmp_path)
    first = made.manifest()["folders"]
    assert made.upsert(spark.createDataFrame([(3, "new", 2), (3, "newer", 3), (500, "added", 1), (3, "late", 0)], KEYED), "seq") == 2
    second = made.manifest()["folders"]
    assert len(first) == 16 and 1 <= sum(first[b] != second[b] for b in first) <= 2
    assert rows(made.read().where("name <> 'old'")) == [(3, "newer", 3), (500, "added", 1)] and made.read().count() == 201
    assert rows(made.read(1).where("k = 3")) == [(3, "old", 1)] and made.read(1).count() == 200
    assert rows(made.lookup(spark.createDataFrame([(3,), (999,)], "k int"))) == [(3, "newer", 3)]
    assert made.upsert(spark.createDataFrame([], KEYED), "seq") == 2 == made.versions()[-1]
    assert made.delete(spark.createDataFrame([(3,), (4,)], "k int")) == 3 and made.read().count() == 199
    made.delete(spark.createDataFrame([(k,) for k in range(600)], "k int"))
    assert rows(made.read()) == [] and made.read(3).count() == 199
    with pytest.raises(StateError):
        made.read(9)
    with pytest.raises(StateError):
        VersionedTable(spark, f"{tmp_path}/none", ["k"]).read()


def test_of_two_writers_neither_is_lost(spark, tmp_path, monkeypatch):
    one, other = table_of(spark, tmp_path), VersionedTable(spark, str(tmp_path), ["k"], 16)
    publish, turns = VersionedTable._publish, []

    def late(self, manifest):
        """Before the first writer publishes, the second one does; the same bucket the first time, another the second."""
        if self is one and len(turns) < 2:
            turns.append(manifest["version"])
            other.upsert(spark.createDataFrame([(7 if len(turns) == 1 else 1000, f"other {len(turns)}", 5)], KEYED), "seq")
        return publish(self, manifest)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    assert one.upsert(spark.createDataFrame([(7, "mine", 4), (8, "mine", 4)], KEYED), "seq") == 4 and turns == [2, 3]
    assert rows(one.read().where("name <> 'old'")) == [(1000, "other 2", 5), (7, "other 1", 5), (8, "mine", 4)]


def test_a_failed_write_leaves_the_old_version_and_vacuum_clears_up(spark, tmp_path, monkeypatch):
    made = table_of(spark, tmp_path)
    monkeypatch.setattr(VersionedTable, "_publish", lambda self, manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        made.upsert(spark.createDataFrame([(1, "lost", 2)], KEYED), "seq")
    monkeypatch.undo()
    assert made.versions() == [1] and made.read().where("name = 'lost'").count() == 0
    made.upsert(spark.createDataFrame([(1, "kept", 2)], KEYED), "seq")
    gone = made.vacuum(keep=2)
    assert len(gone) == 1 and gone[0].startswith("data/") and made.read(1).count() == made.read().count() == 200
    assert made.vacuum() == ["versions/000000000001.json"] and made.versions() == [2] and made.read().count() == 200


def test_a_keyword_is_looked_for_once_along_a_text(spark):
    """As ``ILIKE`` finds it, whatever stands in keyword and text; long texts without it take no longer than others (minutes before)."""
    texts = [*TEXTS, "xΑΣ_Β", "ας.β", "x.*y", "(a|b)$", "in the\nhay", "hay in", "q^2 {3} [z]", "$0\\1", "İx", "%%", "_"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    keywords = ["%", "%%", "_", "", "a_b", "%in%hay%", "in%hay", "hay%in", "ΑΣ_Β", "ας.β", "_Σ", "α%σ", ".*", "x._y", "(a_b)$", "^2 {%[Z]", "\\", "$0\\_", "i̇x%", "b%a"]
    for keyword in keywords:
        like = F.coalesce(F.ilike("text", F.lit("%" + keyword.replace("\\", "\\\\") + "%")), F.lit(False))
        assert rows(df.where(contains_like(F.col("text"), keyword))) == rows(df.where(like)), keyword
    long = spark.range(16).select(F.repeat(F.lit("licen "), 20_000).alias("text"))
    began = time.monotonic()
    assert long.where(contains_like(F.col("text"), "%licen_e%") | contains_like(F.col("text"), "li%ce_ %q")).count() == 0
    assert time.monotonic() - began < 20


def test_a_block_has_each_trigram_once_and_all_of_them(spark, tmp_path):
    rng = random.Random(4)
    docs = [(k, None if k % 17 == 0 else "".join(rng.choice("abÄ漢😀ß\n") for _ in range(rng.choice([0, 1, 2, 3, 40])))) for k in range(200)]
    index = TextIndex(spark, str(tmp_path), "id", "text")
    index.add(spark.createDataFrame(docs, "id int, text string").repartition(3), blocks=2)
    low = {r["id"]: (r["low"] or "", r["block"]) for r in spark.read.parquet(f"{tmp_path}/documents").select("id", "block", F.lower("text").alias("low")).collect()}
    want = sorted({(b, t[i : i + 3]) for t, b in low.values() for i in range(len(t) - 2)}, key=repr)
    assert rows(spark.read.parquet(f"{tmp_path}/grams").select("block", "gram")) == want and len({b for b, _ in want}) == 2


def test_triples_of_few_and_of_many_characters(monkeypatch):
    """Batches are cut anywhere, and a task hands trigrams on when it holds many."""
    rng = random.Random(5)
    for table, most in ((1 << 27, 1 << 20), (0, 40)):
        monkeypatch.setattr(search_index, "TABLE", table)
        monkeypatch.setattr(search_index, "HELD", most)
        batches, want = [], set()
        for _ in range(50):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice("abc ä漢😀") for _ in range(rng.choice([0, 1, 2, 3, 9]))) for _ in range(8)]
            blocks = [rng.randrange(3) for _ in texts]
            want |= {(b, t[i : i + 3]) for b, t in zip(blocks, texts) if t for i in range(len(t) - 2)}
            batches.append(pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(["pad", *texts], pa.string()).slice(1)], names=["block", "text"]))
        assert {tuple(r.values()) for b in search_index._grams(batches) for r in b.to_pylist()} == want
