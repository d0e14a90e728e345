"""Line dedup with sharded cuckoo filters in front of exact reference counts; documents can be added and taken out again.

A text is split at ``\\n`` (null or empty: one empty line). A line's key is the line without ASCII white space at both
ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code points are left alone. A key that at least
``min_docs`` documents hold is frequent: all its lines go, except in the largest id that holds it. Rows that share an id
are one document; rows with a null id count as one more document, and lose nothing.

State, all of it in the shared folder:

* ``holders(id, h1, h2)``: which document holds which key (128-bit hashes of keys), the exact record;
* ``counts(h1, h2, n_docs, last_id)``: the reference counts;
* ``filters(shard, level, slots)``: cuckoo filters of the frequent keys. A key enters the filter when its count reaches
  ``min_docs`` and leaves it when a deletion brings it below. A full filter gets a further level of twice its size.

``thin`` probes each line's key in the filter of its shard, takes the few positives to the exact counts, and rewrites
the texts. Lines go to their shard's filter with a salt (a filter is small and is sent once for each salt), so a line
that a third of all documents hold is probed in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import carried, empty, field, id_field, keyed_text, map_texts, small_batches, text_chunks, written

SPACE = " \t\n\x0b\x0c\r"
SALTS = 32
SLOTS = 4  # in a bucket
_KICKS = 200


def line_key(line: str, min_chars: int) -> bytes | None:
    key = line.strip(SPACE)
    return key.encode().lower() if len(key) >= min_chars else None


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


# -- cuckoo filters, whole arrays of keys at a time ------------------------------------------------------------------


def _tags(h1: np.ndarray, h2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and 16-bit tag (never zero) of keys."""
    tag = (h2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
    return (h1.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (buckets - 1), np.where(tag == 0, 1, tag)


def _other(bucket: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    return (bucket ^ (tag * 0x5BD1E995)) & (buckets - 1)


def filter_probe(slots: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter ``slots`` (buckets x SLOTS tags)."""
    bucket, tag = _tags(h1, h2, len(slots))
    return ((slots[bucket] == tag[:, None]) | (slots[_other(bucket, tag, len(slots))] == tag[:, None])).any(axis=1)


def filter_insert(slots: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> bool:
    """Insert keys in place; False (and ``slots`` half changed) if they don't fit."""
    bucket, tag = _tags(h1, h2, len(slots))
    for turn in range(_KICKS):
        for _ in range(2):
            order = np.argsort(bucket, kind="stable")
            bucket, tag = bucket[order], tag[order]
            first = np.searchsorted(bucket, bucket, side="left")
            nth = np.arange(len(bucket)) - first
            free = slots[bucket] == 0
            fits = nth < free.sum(axis=1)
            column = np.argmax(np.cumsum(free, axis=1) > nth[:, None], axis=1)
            slots[bucket[fits], column[fits]] = tag[fits]
            bucket, tag = bucket[~fits], tag[~fits]
            if not len(bucket):
                return True
            bucket = _other(bucket, tag, len(slots))
        # One key in each full bucket takes a slot; the tag that was there goes on to its other bucket.
        chosen = np.unique(bucket, return_index=True)[1]
        column = (turn + bucket[chosen]) % SLOTS
        put_out = slots[bucket[chosen], column].astype(np.int64)
        slots[bucket[chosen], column] = tag[chosen]
        tag[chosen] = put_out
        bucket[chosen] = _other(bucket[chosen], put_out, len(slots))
    return False


def filter_delete(slots: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Take keys out in place, one tag for each key; returns which keys were found."""
    bucket, tag = _tags(h1, h2, len(slots))
    found = np.zeros(len(bucket), bool)
    for b in (bucket, _other(bucket, tag, len(slots))):
        while True:
            left = np.flatnonzero(~found & (slots[b] == tag[:, None]).any(axis=1))
            if not len(left):
                break
            one = left[np.unique(b[left], return_index=True)[1]]  # one key in each bucket at a time
            slots[b[one], np.argmax(slots[b[one]] == tag[one, None], axis=1)] = 0
            found[one] = True
    return found


def update_levels(levels: list[np.ndarray], added: tuple[np.ndarray, np.ndarray], removed: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The levels of a shard's filter after deletions and insertions of keys."""
    h1, h2 = removed
    for slots in reversed(levels):
        gone = filter_delete(slots, h1, h2)
        h1, h2 = h1[~gone], h2[~gone]
    h1, h2 = added
    if not len(h1):
        return levels
    if levels:
        trial = levels[-1].copy()
        if filter_insert(trial, h1, h2):
            return [*levels[:-1], trial]
    size = max(2 * len(levels[-1]) if levels else 1, 1 << int(np.ceil(np.log2(max(1, len(h1) / (0.8 * SLOTS))))))
    while not filter_insert(slots := np.zeros((size, SLOTS), np.uint16), h1, h2):
        size *= 2
    return [*levels, slots]


# -- state -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """The state after some insertions and deletions; every change makes a new one and leaves the old one valid."""

    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int
    min_docs: int


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(id, h1, h2) for the distinct keys of each row of ``docs``."""

    def make():
        def keys(texts: list[str | None]) -> dict:
            rows, digests = [], []
            for row, text in enumerate(texts):
                own = {key_hash(k) for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None}
                rows += [row] * len(own)
                digests += own
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return {"row": rows, "h1": np.ascontiguousarray(h[:, 0]), "h2": np.ascontiguousarray(h[:, 1])}

        return keys

    return map_texts(docs, id_col, text_col, [field("h1", "bigint"), field("h2", "bigint")], make).withColumnRenamed(id_col, "id")


def empty_index(like: DataFrame, id_col: str = "doc_id", *, min_chars: int = 20, min_docs: int = 3, shards: int = 16) -> LineIndex:
    """An index without documents, for ids of the type that ``like`` has. ``shards`` fits some 100,000 frequent keys each."""
    spark = like.sparkSession
    key = [field("h1", "bigint"), field("h2", "bigint")]
    return LineIndex(
        empty(spark, T.StructType([id_field(like, id_col), *key])),
        empty(spark, T.StructType([*key, field("n_docs", "bigint"), id_field(like, id_col, "last_id")])),
        empty(spark, _FILTERS),
        shards, min_chars, min_docs,
    )


_FILTERS = "shard int, level int, slots binary"


def _shard(shards: int) -> F.Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def _count(holders: DataFrame) -> DataFrame:
    return holders.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id"))


def _refilter(index: LineIndex, changed: DataFrame) -> DataFrame:
    """Filters after ``changed(h1, h2, step)``: step 1 for keys that became frequent, -1 for those that no longer are."""
    keys = changed.select(_shard(index.shards).alias("shard"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("binary").alias("slots"), "h1", "h2", "step")
    none = F.lit(None).cast("long")
    held = index.filters.select("shard", "level", "slots", none.alias("h1"), none.alias("h2"), F.lit(0).alias("step"))

    def update(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows.level.notna()].sort_values("level")
        levels = [np.frombuffer(x, np.uint16).reshape(-1, SLOTS).copy() for x in own.slots]
        pick = lambda step: tuple(rows.loc[rows.step == step, c].to_numpy(np.int64) for c in ("h1", "h2"))
        levels = update_levels(levels, pick(1), pick(-1))
        return pd.DataFrame({"shard": [key[0]] * len(levels), "level": range(len(levels)), "slots": [x.tobytes() for x in levels]})

    # Keys are whole 64-bit numbers: nulls beside them would turn the column into floats, so the two kinds get a zero.
    rows = held.fillna(0, ["h1", "h2"]).unionByName(keys)
    return rows.groupBy("shard").applyInPandas(update, _FILTERS)


def insert(index: LineIndex, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """Add documents. Keys that a document is already known to hold are not counted twice."""
    found = line_keys(docs, id_col, text_col, index.min_chars).distinct()
    if index.holders.isEmpty():
        fresh = holders = written(found, "holders")
        counts = written(_count(fresh), "counts")
        frequent = counts.where(F.col("n_docs") >= index.min_docs)
    else:
        known = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("id", "h1", "h2")]
        fresh = written(found.alias("f").join(index.holders.alias("k"), known, "left_anti"), "holders")
        holders = index.holders.unionByName(fresh)
        both = index.counts.withColumn("old", F.col("n_docs")).unionByName(_count(fresh).withColumn("old", F.lit(0)))
        merged = both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"), F.sum("old").alias("old"))
        merged = written(merged, "counts")
        counts, frequent = merged.drop("old"), merged.where((F.col("old") < index.min_docs) & (F.col("n_docs") >= index.min_docs))
    filters = written(_refilter(index, frequent.select("h1", "h2", F.lit(1).alias("step"))), "filters")
    return LineIndex(holders, counts, filters, index.shards, index.min_chars, index.min_docs)


def delete(index: LineIndex, ids: DataFrame, *, id_col: str = "doc_id") -> LineIndex:
    """Take the documents with these ids out again, as if they had never been inserted."""
    gone = ids.select(F.col(id_col).alias("id")).distinct()
    holders = written(index.holders.join(gone, "id", "left_anti"), "holders")
    touched = written(index.holders.join(gone, "id", "left_semi").select("h1", "h2").distinct(), "touched")
    again = _count(holders.join(touched, ["h1", "h2"], "left_semi"))
    counts = written(index.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(again), "counts")
    was = index.counts.join(touched, ["h1", "h2"]).where(F.col("n_docs") >= index.min_docs).select("h1", "h2")
    now = counts.where(F.col("n_docs") >= index.min_docs).select("h1", "h2")
    filters = written(_refilter(index, was.join(now, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(-1).alias("step"))), "filters")
    return LineIndex(holders, counts, filters, index.shards, index.min_chars, index.min_docs)


def probe(lines: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of ``lines(id, h1, h2)`` whose key may be in the filters (all that are, and about 1 in 8,000 others)."""
    salt = F.pmod(F.xxhash64("id", "h2"), F.lit(SALTS)).cast("int")
    dealt = lines.select(_shard(shards).alias("shard"), salt.alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("level"), "id", "h1", "h2", F.lit(None).cast("binary").alias("slots"))
    every = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    zero = F.lit(0).cast("long")
    sent = filters.select("shard", every.alias("salt"), F.lit(0).alias("kind"), "level", F.lit(None).cast(lines.schema["id"].dataType).alias("id"), zero.alias("h1"), zero.alias("h2"), "slots")
    rows = dealt.unionByName(sent).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "level")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, levels = None, []
        for batch in batches:
            kind, shards_, h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "shard", "h1", "h2"))
            cuts = np.flatnonzero((np.diff(shards_) != 0) | (np.diff(kind) != 0) | (kind[1:] == 0)) + 1
            hit = np.zeros(len(kind), bool)
            for a, b in zip([0, *cuts], [*cuts, len(kind)]):
                if a == b:
                    continue
                if shards_[a] != shard:
                    shard, levels = shards_[a], []
                if kind[a] == 0:
                    if batch.column("level")[a].as_py() == 0:  # the same shard comes again with another salt
                        levels = []
                    levels.append(np.frombuffer(batch.column("slots")[a].as_py(), np.uint16).reshape(-1, SLOTS))
                else:
                    for slots in levels:
                        hit[a:b] |= filter_probe(slots, h1[a:b], h2[a:b])
            at = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("id", "h1", "h2")], names=["id", "h1", "h2"])

    return rows.mapInArrow(look_up, lines.schema)


def drops(index: LineIndex, lines: DataFrame) -> DataFrame:
    """(id, gone): for each document that loses lines, the hashes of their keys, 16 bytes each, one after another."""
    frequent = index.counts.where(F.col("n_docs") >= index.min_docs)
    lost = probe(lines, index.filters, index.shards).join(frequent, ["h1", "h2"]).where(F.col("id") < F.col("last_id"))
    pairs = F.transform(F.collect_list(F.struct("h1", "h2")), lambda x: F.array(x["h1"], x["h2"]))
    return lost.groupBy("id").agg(F.flatten(pairs).alias("gone"))


def thin(index: LineIndex, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Return id, text (without the lines that go), n_lines, n_dropped and the columns in ``carry``, one row for each row of ``docs``.

    Which keys a document holds is read from the index, not from its text again; a document that isn't in the index
    comes back whole. A carried column that is called like a result gives way to it.
    """
    small_batches(docs.sparkSession)
    carry = carried(carry, [id_col, "text", "n_lines", "n_dropped"])
    lost = drops(index, index.holders.where("id IS NOT NULL"))
    min_chars = index.min_chars
    schema = T.StructType([id_field(docs, id_col, id_col), field("text", "string"), field("n_lines", "bigint"), field("n_dropped", "bigint"), *(docs.schema[c] for c in carry)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, 1 << 20):
            kept, lines, lost_lines = [], [], []
            for text, gone in zip(texts, rows.column(2)):
                text = text or ""
                n = stay = text.count("\n") + 1
                if gone.is_valid:
                    packed = np.ascontiguousarray(gone.values.to_numpy(zero_copy_only=False)).tobytes()
                    hashes = {packed[i : i + 16] for i in range(0, len(packed), 16)}
                    staying = [x for x in text.split("\n") if (k := line_key(x, min_chars)) is None or key_hash(k) not in hashes]
                    text, stay = "\n".join(staying), len(staying)
                kept.append(text)
                lines.append(n)
                lost_lines.append(n - stay)
            made = [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(lost_lines, pa.int64())]
            yield pa.RecordBatch.from_arrays([rows.column(0), *made, *rows.columns[3:]], names=schema.names)

    joined = keyed_text(docs, id_col, text_col, carry).join(lost, "id", "left")
    return joined.select("id", "text", "gone", *(f"c{i}" for i in range(len(carry)))).mapInArrow(rewrite, schema)


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: Sequence[str] = ()
) -> DataFrame:
    """Index all of ``docs`` and thin them: the whole of the operator over one table."""
    shards = max(16, docs.count() // 500_000)
    index = insert(empty_index(docs, id_col, min_chars=min_chars, min_docs=min_docs, shards=shards), docs, id_col=id_col, text_col=text_col)
    return thin(index, docs, id_col=id_col, text_col=text_col, carry=carry)
