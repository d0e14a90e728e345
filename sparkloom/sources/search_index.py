"""Contains-search over stored texts without reading them all: blocks of documents and the trigrams that each block has.

Documents are dealt to blocks by a hash of their id and stored as Parquet, a folder for each block; beside them lies which
trigrams (of the lower-cased text) occur in which blocks, sorted by trigram. A keyword's own trigrams, of what stands
between its wildcards, tell the blocks that can have it; only those are read, and each text is compared exactly, so the
rows are those of a scan. A keyword of rare trigrams reads few blocks, one of frequent ones reads them all.

Documents are added as new blocks; nothing that is there is written again. Deleted ids are noted with the newest block of
that moment, so a document that is added again later counts. A document's trigrams are taken as triples of code points, many
texts at a time, and a task names a trigram once for each block, however many of the block's documents have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import contains_like
from sparkloom.session import small_batches

GRAM = 3
HELD = 1 << 20  # trigrams of a block that a task holds before it hands them on
TABLE = 1 << 27  # entries of a table of all triples of a batch's characters, at most; else triples are sorted


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text, as an array."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1))))


def _triples(texts: pa.Array) -> np.ndarray:
    """The distinct triples of neighbouring code points within texts, 21 bits a code point, ascending."""
    texts = texts.drop_null()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64)
    held = texts.buffers()[2][offsets[0] : offsets[-1]]
    points = np.frombuffer(str(held, "utf-8").encode("utf-32-le"), np.uint32)
    begins = np.cumsum((np.frombuffer(held, np.uint8) & 0xC0) != 0x80)  # of characters, up to and including a byte
    ends = np.concatenate([[0], begins])[offsets[1:] - offsets[0]]
    inside = np.ones(len(points), bool)  # whether a triple begins here
    inside[np.maximum(ends[ends > 0] - 1, 0)] = inside[np.maximum(ends[ends > 0] - 2, 0)] = False
    known = np.zeros(0x110000, np.int64)
    known[points] = 1
    letters = np.flatnonzero(known)
    known[letters] = np.arange(len(letters))
    place, n = known[points], len(letters)
    triples = ((place[:-2] * n + place[1:-1]) * n + place[2:])[inside[:-2]]
    if n**3 <= TABLE:
        there = np.zeros(n**3, bool)
        there[triples] = True
        triples = np.flatnonzero(there)
    else:
        triples = np.unique(triples)
    return letters[triples // (n * n)] << 42 | letters[triples // n % n] << 21 | letters[triples % n]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram) for batches of (block, lower-cased text)."""
    held: dict[int, np.ndarray] = {}

    def named(block: int) -> Iterator[pa.RecordBatch]:
        triples = held.pop(block)
        for k in range(0, len(triples), 50_000):
            part = triples[k : k + 50_000]
            points = np.stack([part >> 42, part >> 21 & 0x1FFFFF, part & 0x1FFFFF], 1).astype(np.uint32)
            joined = points.tobytes().decode("utf-32-le")
            grams = [joined[i : i + GRAM] for i in range(0, len(joined), GRAM)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(grams, pa.string())], names=["block", "gram"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for block in np.unique(blocks).tolist():
            found = _triples(batch.column(1).filter(pa.array(blocks == block)))
            held[block] = np.union1d(held[block], found) if block in held else found
            if len(held[block]) > HELD:
                yield from named(block)
    for block in list(held):
        yield from named(block)


class TextIndex:
    """An index in a folder that driver and executors share; ``id_col`` and ``text_col`` are columns of the documents."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str, text_col: str) -> None:
        self.spark, self.folder, self.id_col, self.text_col = spark, folder.rstrip("/"), id_col, text_col

    def _there(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _newest(self) -> int:
        held = self._there("documents")
        return -1 if held is None else held.agg(F.max("block")).first()[0]  # from the folders' names

    def add(self, docs: DataFrame, blocks: int = 64) -> None:
        """Store documents in so many new blocks; choose as many as make a block some hundred MB."""
        base = self._newest() + 1
        block = (F.pmod(F.xxhash64(self.id_col), F.lit(blocks)) + base).cast("int")
        docs.withColumn("block", block).repartition("block").write.mode("append").partitionBy("block").parquet(f"{self.folder}/documents")
        held = self._there("documents")
        if held is None:
            return
        small_batches(self.spark)
        texts = held.where(F.col("block") >= base).select("block", F.lower(self.text_col))
        grams = texts.mapInArrow(_grams, "block int, gram string").distinct()
        grams.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{self.folder}/grams")

    def delete(self, ids: DataFrame) -> None:
        """Forget the documents with these ids that are there now."""
        ids.select(self.id_col).distinct().withColumn("upto", F.lit(self._newest())).write.mode("append").parquet(f"{self.folder}/deleted")

    def blocks(self, keyword: str) -> list[int] | None:
        """The blocks that have all trigrams of a keyword; None if it has none, and every block may hold it."""
        parts = self.spark.createDataFrame([(p,) for p in re.split("[%_]", keyword)], "part string")
        wanted = sorted({r["gram"] for r in parts.select(F.explode(trigrams(F.col("part"))).alias("gram")).collect()})
        grams = self._there("grams")
        if not wanted or grams is None:
            return None
        met = grams.where(F.col("gram").isin(wanted)).groupBy("block").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted))
        return sorted(r["block"] for r in met.select("block").collect())  # no more than there are blocks

    def search(self, keyword: str) -> DataFrame:
        """The documents that contain a keyword as ``functions.text.contains_like`` says, ``%`` and ``_`` being wildcards."""
        held = self._there("documents")
        if held is None:
            raise FileNotFoundError(f"{self.folder} has no documents")
        near = self.blocks(keyword)
        found = held if near is None else held.where(F.col("block").isin(near)) if near else held.where("false")
        found = found.where(contains_like(F.col(self.text_col), keyword))
        gone = self._there("deleted")
        if gone is not None:
            last = gone.groupBy(F.col(self.id_col).alias("gone id")).agg(F.max("upto").alias("gone upto"))
            found = found.join(last, (F.col(self.id_col) == F.col("gone id")) & (F.col("block") <= F.col("gone upto")), "left_anti")
        return found.drop("block")
