"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words are runs of anything but ASCII white space, after A-Z are lower-cased; its shingles are ``words``
neighbouring words joined by single spaces, repeats included. With fewer words the whole sequence is the only shingle;
without any (null, empty, blank) the fingerprint is zero, and such documents are linked like all others. A bit is set
if it is set in more than half of the shingles' XXH64 hashes, so a tie clears it.

Two fingerprints within ``radius`` bits have a common variant within ``radius / 2`` bits of both. Every distinct
fingerprint emits all of its variants; those that meet at a variant are linked in a chain, not pair by pair: they are
all within the radius of each other, so the chain keeps every connection, and a variant has at most as many
fingerprints as its ball has points, however many documents there are. Exact copies are merged before anything is
emitted.
Rows that repeat an id are rows of their own; they are linked by their texts alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import field, map_texts, remove, scope, written

SEED = 42


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(last))


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in more than half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64))[0])


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = SEED) -> DataFrame:
    """Return id and ``fp`` (the fingerprint's 64 bits as a signed long), one row for each row of ``docs``."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, id_col, text_col, [field("fp", "bigint")], make)


def _masks(bits: int) -> list[int]:
    """All words of up to ``bits`` set bits, as signed longs."""
    found = [sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, among the distinct fingerprints of ``prints(fp)``: within the radius, enough to connect all that are."""
    if radius < 2 or radius % 2:
        raise ValueError("the radius must be even and at least 2: both sides emit the same ball")
    variants = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in _masks(radius // 2)])).alias("mask"))
    met = variants.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    chained = met.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return chained.where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


SMALL = 100_000  # edges that one task takes without a shuffle


def components(edges: DataFrame) -> DataFrame:
    """Return (node, root) for every node of ``edges(a, b)``: root is the smallest node that can be reached.

    Alternates large-star and small-star steps (each a group-by and a join over the edges left) until nothing moves.
    Every round is written to the shared folder, so a lost executor repeats one round at most, and nothing but two sums
    reaches the driver. A round over no more than ``SMALL`` edges is one task: its shuffles would cost more than they deal out.
    """
    edges, before = written(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
        before = tuple(state)
        dealt = (lambda df: df.coalesce(1)) if state[0] <= SMALL else (lambda df: df)
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
        both = dealt(edges).select(ends).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))
        large = dealt(large.union(low.where("low < u").select("low", "u"))).where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
        after = written(dealt(small.union(low.select("low", "b"))).distinct(), "links")
        remove(edges)
        edges = after


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = SEED) -> DataFrame:
    """Return id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links), one row for each row.

    Components are found among fingerprints and named by their smallest id afterwards. A null id is never the smallest;
    a component has a null name only if all of its ids are null.
    """
    with scope() as keep:
        rows = keep(written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed).toDF("id", "fp"), "fingerprints"))
        groups = rows.groupBy("fp").agg(F.min("id").alias("low"))
        rooted = groups.join(components(links(groups.select("fp"), radius)).withColumnRenamed("node", "fp"), "fp", "left")
        lowest = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("lowest"))
        named = keep(written(rooted.join(lowest, "root", "left").select("fp", F.coalesce("lowest", "low").alias("component_id")), "named"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
