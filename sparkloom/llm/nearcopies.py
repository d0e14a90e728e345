"""SimHash near-dedup at a similarity: every pair of texts of at least 0.8 (Jaccard of word shingles) is linked, no other is.

Fingerprints alone can't do that: at 0.8 two of 64 bits are about ten bits apart, and a ball of half that radius has
millions of variants. So balls (of ``simhash``, over fingerprints of the same shingles) bring together the closest pairs,
whose sets are compared, and a filter that loses nothing finds the others.

Words and shingles are those of ``simhash``, ``words`` neighbouring words each; a text counts as the set of its
shingles' XXH64 hashes, and texts of one set (among them all without a word) are one representative. Two sets of a and b
shingles of at least 0.8 share 4/9 of a + b or more, and so at least 0.8 n, n the larger size. In any order that holds
for all shingles, all but ``0.8 n - extra`` of them are then among the first ``0.2 n + extra`` of each, and only those
are shuffled. The order is that of the hashes, with the shingles of crowds last: where ``HOT`` or more sets have a shingle
in their first ones, ``TAKEN`` of those sets are looked at as a whole, and what ``OFTEN`` or more of all looked at hold
goes last. So texts that share a template but not 0.8 meet at what is their own, which is nowhere. What is looked at is
spread over all crowds, however many there are; it decides how much is compared, never what is found. A Bloom filter of
at most 32 MB holds the shingles of crowds: one that is too small puts others last too, for all texts alike.

What the driver holds is bounded by that and by ``NUMBERS``. Texts that are read again are told by such a filter where there
are more of them than that; what it lets pass besides is harmless, or goes in a join of the few rows that pass.

Pairs that meet often enough are verified on their whole sets. Those that meet in a ball and neighbours among those that
meet at a shingle come first, in ``ORDERS`` orders (in later ones ``NEIGHBOURS`` of other components on either side); what
they link needs no further comparison, so a large group of near copies isn't compared pair by pair. Then every pair of
different components that meets often enough is verified.

Null and empty texts are copies of each other. Rows that repeat an id are rows of their own. Where one row of each group
is to stay it is the one with the smallest id (nulls last); of rows that share that id, one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import bloom
from sparkloom.llm._common import field, map_texts, scope, small, written
from sparkloom.llm.simhash import SEED, components, links, majority, shingle_hashes
from sparkloom.session import counted


def shingles(text: str | None, words: int = 5, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, words, seed))


def _keys(docs: DataFrame) -> DataFrame:
    """Add ``t1`` and ``t2``, which are equal for equal texts."""
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})


NUMBERS = 1_000_000  # of a table that is broadcast, at most: the driver holds it several times over while it is sent


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its columns hold no more than ``NUMBERS`` numbers; else it is shuffled."""
    return small(table, NUMBERS // len(table.columns))


def _may_be_in(keys: DataFrame, n: int) -> Column:
    """Whether a row's ``t1`` may be one of the ``n`` in ``keys``: a Bloom filter of at most 32 MB, which hardly any others pass."""
    sent = keys.sparkSession.sparkContext.broadcast(bloom.of_hashes(keys.select(F.col("t1").alias("hash")), n, BITS))

    @F.pandas_udf("boolean")
    def passes(t1: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(sent.value, t1.to_numpy(np.int64).view(np.uint64)))

    return passes("t1")


def _among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``t1`` and ``t2`` are in ``keys``, written; of too many to be broadcast a few others too. No text is shuffled."""
    n = keys.count()
    if n * len(keys.columns) <= NUMBERS:
        return docs.join(F.broadcast(keys), ["t1", "t2"], "left_semi")
    return docs.where(_may_be_in(keys, n))


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A semi or anti join with ``keys(id, t1, t2)``, written, in which nulls are equal; of too many to be broadcast only rows that may match are shuffled."""
    n = keys.count()
    named = keys.toDF("key id", "key t1", "key t2")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"key {c}")) for c in ("id", "t1", "t2")])
    if n * len(keys.columns) <= NUMBERS:
        return docs.join(F.broadcast(named), same, how)
    may = _may_be_in(keys, n)
    met = docs.where(may).join(named, same, how)
    return met if how == "left_semi" else docs.where(~may).unionByName(met)


HOT, TAKEN, OFTEN = 16, 8, 3
BITS = 28  # base-2 logarithm of the filter's bits at most


def _sets(texts: DataFrame, key: str, words: int) -> DataFrame:
    """(key, own): the whole set of each text."""
    return map_texts(texts, key, "text", [field("own", "array<bigint>")], lambda: lambda found: {"own": [shingles(t, words).view(np.int64) for t in found]})


def _crowds(docs: DataFrame, rows: DataFrame, words: int) -> np.ndarray | None:
    """A Bloom filter of the shingles that several of a crowd hold, if there is any.

    Crowds are told by every second shingle of ``rows(s1, s2, t1, t2, prefix)``; each gives the sets whose hashes come
    first in one of ``TAKEN`` orders, a partial aggregate, so no task sees a whole crowd.
    """
    prefixes = rows.where("prefix IS NOT NULL").select("s1", "s2", F.struct("t1", "t2").alias("text"), F.explode("prefix").alias("shingle")).where("shingle & 1 = 0")
    hot, n = counted(prefixes.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("shingle"), "hot")
    if not n:
        return None
    taken = [F.min(F.struct(F.xxhash64("s1", "s2", F.lit(k)).alias("h"), "s1", "s2", "text")).alias(f"c{k}") for k in range(TAKEN)]
    chosen = prefixes.join(_sent(hot), "shingle").groupBy("shingle").agg(*taken).select(F.explode(F.array(*[f"c{k}" for k in range(TAKEN)])).alias("c"))
    chosen = written(chosen.groupBy("c.s1", "c.s2").agg(F.min("c.text").alias("text")).select("text.*").distinct(), "chosen")
    texts = _among(docs, chosen).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    held = _sets(texts, "t1", words).select(F.explode("own").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    common, n = counted(held.select("hash"), "common")
    return bloom.of_hashes(common, n, BITS) if n else None


def _prefixes(docs: DataFrame, words: int, extra: int, last: Broadcast | None = None) -> DataFrame:
    """(id, s1, s2, n, fp, prefix, t1, t2), one row for each row of ``docs``; s1 and s2 are equal for equal sets.

    Shingles in the filter ``last`` go last. Each task gives the prefix of a set once, so copies of a text aren't sent
    again and again.
    """

    def make():
        seen: set[bytes] = set()

        def found(texts: list[str | None]) -> dict:
            out = {"s": [], "n": [], "fp": [], "prefix": []}
            for t in texts:
                every = shingle_hashes(t, words)
                own = np.unique(every)
                n, digest = len(own), xxhash.xxh3_128_digest(own.tobytes())
                out["s"].append(digest)
                out["n"].append(n)
                out["fp"].append(majority(every))
                if digest in seen:
                    out["prefix"].append(None)
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(digest)
                if last is not None:
                    own = own[np.argsort(bloom.holds(last.value, own), kind="stable")]
                out["prefix"].append(own[: n - max(0, (4 * n + 4) // 5 - extra)].view(np.int64))
            both = np.frombuffer(b"".join(out["s"]), np.int64).reshape(-1, 2)
            return out | {"s1": np.ascontiguousarray(both[:, 0]), "s2": np.ascontiguousarray(both[:, 1]), "fp": np.array(out["fp"], np.uint64).view(np.int64)}

        return found

    fields = [field("s1", "bigint"), field("s2", "bigint"), field("n", "int"), field("fp", "bigint"), field("prefix", "array<bigint>")]
    return map_texts(docs, "id", "text", fields, make, carry=["t1", "t2"])


def _ordered(docs: DataFrame, rows: DataFrame, words: int, extra: int) -> DataFrame:
    """(s1, s2, prefix) with the shingles of crowds last. Only texts that have one in their prefix are read again."""
    first = rows.where("prefix IS NOT NULL").select("s1", "s2", "t1", "t2", "prefix")
    filter_ = _crowds(docs, rows, words)
    if filter_ is None:
        return first.select("s1", "s2", "prefix")
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            ends = prefix.offsets.to_numpy()
            hit = bloom.holds(sent.value, prefix.values.to_numpy(zero_copy_only=False).view(np.uint64))
            sums = np.concatenate([[0], np.cumsum(hit)])
            yield batch.append_column("hit", pa.array(sums[ends[1:]] > sums[ends[:-1]]))

    marked = written(first.mapInArrow(mark, "s1 long, s2 long, t1 long, t2 int, prefix array<bigint>, hit boolean"), "marked")
    again = written(marked.where("hit").select("t1", "t2").distinct(), "again")
    anew = _prefixes(_among(docs, again), words, extra, sent).where("prefix IS NOT NULL")
    return marked.where("NOT hit").select("s1", "s2", "prefix").union(anew.select("s1", "s2", "prefix"))


def _in_balls(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives: those of equal fingerprints with their first, and the first ones of neighbouring fingerprints."""
    first = reps.groupBy("fp").agg(F.min("uid").alias("first"))
    equal = reps.join(first, "fp").where("uid > first").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    near = links(first.select("fp")).join(first.toDF("a", "ua"), "a").join(first.toDF("b", "ub"), "b")
    return equal.union(near.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of those ``pairs(a, b)``, written, whose sets are at least 0.8 alike."""
    first = sets.toDF("a", "own").join(_sent(pairs), "a")
    used = sets.join(_sent(pairs.select(F.col("b").alias("uid"))), "uid", "left_semi").toDF("b", "other")
    both = first.join(used, "b")
    shared = F.size(F.array_intersect("own", "other"))
    return both.where(9 * shared >= 4 * (F.size("own") + F.size("other"))).select("a", "b")


def _often(met: DataFrame, extra: int, share: int = 1) -> DataFrame:
    """Pairs of ``met(a, b, na, nb)``, a row for each meeting, that meet as often as near copies must, or a ``share`` of it."""
    fits = met.where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    return fits.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("times")).where(F.col("times") * share >= _need(extra)).select("a", "b")


def _need(extra: int) -> Column:
    """How many shingles of their prefixes two near copies of na and nb shingles share at least."""
    most = F.greatest("na", "nb")
    return F.ceil(4 * (F.col("na") + F.col("nb")) / 9) - F.greatest(F.lit(0), F.ceil(4 * most / 5) - extra)


def _across(mixed: DataFrame, extra: int, first: int = 1) -> DataFrame:
    """Pairs (a, b) of different components that may be near copies, from ``mixed(shingle, uid, n, root)``.

    Each prefix is put in one order for all: first the shingles that no other component has, then those that few rows
    have. Of p shingles, ``need`` or more of which are shared, the ``first`` shared ones stand among the first
    ``p - need + first``, on both sides; only those meet, and a pair has to meet so often. Shingles that most of a group
    of texts have stand last and meet least.
    """
    often = mixed.groupBy("shingle").agg(F.count("*").alias("held"))
    own = Window.partitionBy("uid")
    size = F.col("n") - F.greatest(F.lit(0), F.ceil(4 * F.col("n") / 5) - extra)
    place = size - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "shingle"))
    placed = mixed.join(often, "shingle").select("shingle", "uid", "n", "root", size.alias("p"), place.alias("place"))
    placed = placed.where(F.col("place") <= F.col("p") - F.least(F.lit(extra), F.ceil(4 * F.col("n") / 5)) + first)
    left, right = placed.toDF("shingle", "a", "na", "ra", "pa", "at"), placed.toDF("shingle", "b", "nb", "rb", "pb", "bt")
    need = _need(extra)
    beyond = need - F.least(need, F.lit(first))
    fits = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    meets = left.join(right, "shingle").where(fits & (F.col("at") <= F.col("pa") - beyond) & (F.col("bt") <= F.col("pb") - beyond))
    counted = meets.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("times"))
    return counted.where(F.col("times") >= F.least(need, F.lit(first))).select("a", "b")


ORDERS, NEIGHBOURS = 2, 8


def _neighbours(shared: DataFrame, turn: int, width: int) -> DataFrame:
    """Meetings (a, b, na, nb) of each row with the ``width`` rows before it at its shingle, of other components, in an order of ``turn``."""
    order = Window.partitionBy("shingle").orderBy(F.xxhash64("uid", F.lit(turn)), "uid")
    before = F.array(*[F.struct(*[F.lag(c, k).over(order).alias(c) for c in ("uid", "n", "root")]) for k in range(1, width + 1)])
    met = shared.withColumn("before", before).select("uid", "n", "root", F.explode("before").alias("o")).where("o.uid IS NOT NULL AND o.root <> root")
    rises = F.col("uid") > F.col("o.uid")
    ends = (("o.uid", "uid", "a"), ("uid", "o.uid", "b"), ("o.n", "n", "na"), ("n", "o.n", "nb"))
    return met.select(*[F.when(rises, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in ends])


def _named(docs: DataFrame, words: int, extra: int) -> DataFrame:
    """(id, t1, t2, component_id, first) for the rows of ``docs(id, text, t1, t2)``; the row ``first`` is the one to stay."""
    with scope() as keep:
        rows = written(_prefixes(docs, words, extra).withColumn("uid", F.monotonically_increasing_id()), "prefixes")
        low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("uid").alias("row")))
        own = F.min_by(F.struct("t1", "t2", "n", "fp"), "uid")
        groups = rows.groupBy("s1", "s2").agg(low.alias("low"), F.min("uid").alias("uid"), own.alias("own"))
        reps = written(groups.select("s1", "s2", "uid", "low", "own.*"), "representatives")

        order = Window.partitionBy("shingle").orderBy("s1", "s2")
        other = lambda move: F.coalesce((move("s1").over(order) != F.col("s1")) | (move("s2").over(order) != F.col("s2")), F.lit(False))
        met = _ordered(docs, rows, words, extra).select("s1", "s2", F.explode("prefix").alias("shingle")).withColumn("other", other(F.lag) | other(F.lead))
        several = met.where("other").select("shingle", "s1", "s2").distinct()
        shared = written(several.join(reps.select("s1", "s2", "uid", "n"), ["s1", "s2"]).select("shingle", "uid", "n"), "shared")
        least = F.least(F.lit(extra), F.ceil(4 * F.col("n") / 5))
        able = shared.groupBy("uid", "n").agg(F.count("*").alias("times")).where(F.col("times") >= least).select("uid")
        able = written(reps.select("uid", "t1", "t2", "fp").join(able, "uid"), "able")
        shared = written(shared.join(_sent(able.select("uid")), "uid", "left_semi"), "shared")
        texts = _among(docs, able.select("t1", "t2")).groupBy("t1", "t2").agg(F.first("text").alias("text"))
        sets = written(_sets(texts.join(_sent(able.select("uid", "t1", "t2")), ["t1", "t2"]), "uid", words), "sets")

        steps = _in_balls(able).union(_often(_neighbours(shared.withColumn("root", F.col("uid")), 0, 1), extra, 2)).distinct()
        found, last = written(_verified(written(steps, "pairs"), sets), "links"), None
        for turn in range(1, ORDERS + 1):
            roots = _sent(written(components(found).toDF("uid", "root"), "roots"))
            at = shared.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
            several = at.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
            last = written(at.join(several, "shingle", "left_semi").select("shingle", "uid", "n", "root"), "mixed")
            if turn < ORDERS:
                more = _verified(written(_often(_neighbours(last, turn, NEIGHBOURS), extra, 2), "pairs"), sets)
                found = written(found.union(more), "links")
        roots = _sent(written(components(found.union(_verified(written(_across(last, extra), "pairs"), sets))), "roots"))

        rooted = reps.select("s1", "s2", "uid", "low").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
        lowest = written(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("lowest")), "lowest")
        named = rooted.join(_sent(lowest), "root", "left").select("s1", "s2", F.coalesce("lowest", "low").alias("low"))
        made = rows.select("id", "t1", "t2", "uid", "s1", "s2").join(named, ["s1", "s2"])
        return keep(written(made.select("id", "t1", "t2", F.col("low.id").alias("component_id"), (F.col("uid") == F.col("low.row")).alias("first")), "named"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, extra: int = 8) -> DataFrame:
    """Return id and component_id (the smallest id reachable over links), one row for each row of ``docs``.

    A null id is never the smallest; a component has a null name only if all of its ids are null.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _named(_keys(given), words, extra).select(F.col("id").alias(id_col), "component_id")


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, extra: int = 8) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    given = _keys(plain.withColumns({"id": F.col(id_at), "text": F.col(text_at).cast("string")}))
    with scope() as keep:
        named = _named(given.select("id", "text", "t1", "t2"), words, extra)
        keys = named.groupBy("id", "t1", "t2").agg(F.max("first").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1")
        keys = written(keys, "keys")
        gone, again = keep(written(keys.where("NOT stays").drop("stays", "n"), "gone")), keep(written(keys.where("stays").drop("stays", "n"), "again"))
    kept = _matched(given, gone, "left_anti")
    if not again.isEmpty():  # rows that are alike in id and text: one of them stays
        once = _matched(given, again, "left_semi").dropDuplicates(["id", "t1", "t2"])
        kept = _matched(kept, again, "left_anti").unionByName(once)
    return kept.drop("id", "text", "t1", "t2").toDF(*docs.columns)
