"""Relational operators of an extract-transform-load and archive workload, as plain DataFrame expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import contains_like, normalize_subject
from sparkloom.operators import scans
from sparkloom.session import remove, written

#: Fixed value: the thread of mails without a subject.
NO_SUBJECT = "(无主题)"


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the last in ``order``. An aggregate with map-side combine, not a sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_best"))
    return best.select(*keys, *[F.col("_best._row").getField(c).alias(c) for c in rest]).select(df.columns)


def lookup_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, columns: dict[str, str], build_order: Sequence[Column] = ()) -> DataFrame:
    """Inner join that keeps every column of ``probe`` and adds ``columns`` (of ``build``: new name).

    Of several build rows with one key the last in ``build_order`` counts (no order: keys are taken to be unique). Spark
    chooses how to join: it broadcasts the build side only where its size is known to be small.
    """
    if build_order:
        build = last_per_key(build, [build_key], build_order)
    taken = build.select(F.col(build_key).alias("_key"), *[F.col(c).alias(name) for c, name in columns.items()])
    return probe.join(taken, F.col(probe_key) == F.col("_key")).drop("_key")


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def one_row(**aggregates: DataFrame) -> DataFrame:
    """Several one-row results side by side, each as a struct named after it."""
    single = [df.limit(1).select(F.struct("*").alias(name)) for name, df in aggregates.items()]
    out = single[0]
    for df in single[1:]:
        out = out.crossJoin(df)  # one row by one row
    return out


def search(df: DataFrame, keyword: str, fields: Sequence[str]) -> DataFrame:
    """Rows in which any of ``fields`` contains ``keyword``, case-insensitively; ``%`` and ``_`` in it are wildcards."""
    found = F.lit(False)
    for f in fields:
        found = found | contains_like(F.col(f), keyword)
    return df.where(found)


def page(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page; ``order`` should end in a unique column. Spark takes the top of each partition, without a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def _before(order: Sequence[str], cut: Sequence[object], types: Sequence[T.DataType], after: bool = False) -> Column:
    """Whether a row stands before (or after) a place in rising ``order``, nulls first; never null."""
    beyond = F.lit(False)
    for name, value, kind in reversed(list(zip(order, cut, types))):
        at, known = F.col(name), F.lit(value).cast(kind)
        if value is None:
            beyond = at.isNotNull() | beyond if after else at.isNull() & beyond
        else:
            beyond = F.coalesce(at > known, F.lit(False)) | (at.eqNullSafe(known) & beyond) if after else F.coalesce(at < known, F.lit(True)) | (at.eqNullSafe(known) & beyond)
    return beyond


def deep_page(df: DataFrame, order: Sequence[str], limit: int = 100, offset: int = 0, rows: int = 1_000_000, sample: int = 4096, parts: int = 64) -> DataFrame:
    """``page`` for an offset far behind: rising ``order`` (nulls first), which should be total, without a sort of all rows.

    A sample of about so many rows gives a place before and one after the page, further from it than chance, and than a part
    of so many would be. In one scan the rows before both, between them and after them are counted exactly and those
    between are written; where the page isn't all there, the rows of the ranges that it lies in are. They are looked at in
    the same way, until about ``rows`` are left to be sorted: the sample bounds how much is read again and not what is
    found. All rows are read twice, those left hardly count, and nothing is shuffled but the sample.
    """
    skip, n, own = offset, df.count(), None
    types = [df.schema[c].dataType for c in order]
    while n > rows and skip < n:
        drawn = df.select(*order).sample(min(1.0, sample / n), 7).agg(F.sort_array(F.collect_list(F.struct(*order)))).first()[0]
        margin = 1 + max(len(drawn) // parts, int(1.5 * len(drawn) ** 0.5))  # three standard deviations at least
        first, last = skip * len(drawn) // n - margin, (skip + limit) * len(drawn) // n + margin
        below = _before(order, drawn[first], types) if first >= 0 else F.lit(False)
        above = _before(order, drawn[last], types, after=True) if last < len(drawn) else F.lit(False)
        if first < 0 and last >= len(drawn):
            break
        ranges, seen = [below, ~below & ~above, above], Observation()
        made = written(df.observe(seen, *[F.count_if(r).alias(f"n{k}") for k, r in enumerate(ranges)]).where(ranges[1]), "page")
        counts = [seen.get[f"n{k}"] for k in range(3)]
        begin, end = min(skip, n - 1), min(skip + max(limit, 1), n) - 1  # the page's first and last row
        met = [k for k in range(3) if sum(counts[:k]) <= end and begin < sum(counts[: k + 1])]
        left = sum(counts[k] for k in met)
        if left == n:
            remove(made)
            break
        if met != [1]:
            remove(made)
            made = written(df.where(reduce(or_, [ranges[k] for k in met])), "page")
        if own is not None:
            remove(own)
        df = own = made
        skip, n = skip - sum(counts[: met[0]]), left
    return page(df, [F.col(c) for c in order], limit, skip)


def group_threads(df: DataFrame, subject_col: str, key_col: str, order_col: str) -> DataFrame:
    """(subject, n, first_key, last_key, latest): rows grouped by their normalised subject; empty ones share a label."""
    normal = normalize_subject(F.coalesce(F.col(subject_col), F.lit("")))
    named = df.select(F.when(normal == "", NO_SUBJECT).otherwise(normal).alias("subject"), F.col(key_col).alias("k"), F.col(order_col).alias("o"))
    return named.groupBy("subject").agg(F.count("*").alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.max("o").alias("latest"))


def threads_with_members(df: DataFrame, subject_col: str, order_col: str, key_col: str, most: int) -> DataFrame:
    """Members of each thread, newest first, at most ``most`` of them (a preview: threads can be of any size)."""
    normal = normalize_subject(F.coalesce(F.col(subject_col), F.lit("")))
    named = df.withColumn("thread", F.when(normal == "", NO_SUBJECT).otherwise(normal))
    order = Window.partitionBy("thread").orderBy(F.desc_nulls_last(order_col), key_col)
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def whole_threads(df: DataFrame, subject_col: str, order_col: str, key_col: str, rows: int = scans.ROWS) -> DataFrame:
    """All members of each thread with their ``place``, oldest first (nulls before); a thread may hold all rows."""
    normal = normalize_subject(F.coalesce(F.col(subject_col), F.lit("")))
    named = df.withColumn("thread", F.when(normal == "", NO_SUBJECT).otherwise(normal))
    return scans.running(named, ["thread"], [order_col, key_col], place="place", rows=rows)


def lookup_by_id(df: DataFrame, key_col: str, value: object) -> DataFrame:
    return df.where(F.col(key_col) == F.lit(value))


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: Sequence[str], seq_col: str) -> DataFrame:
    """``current`` with ``incoming`` put in: of all rows with one key the one with the highest ``seq_col`` stays."""
    return last_per_key(current.unionByName(incoming), keys, [F.col(seq_col)])


def surrogate_id(*columns: str) -> Column:
    """An id that follows from its columns, where a sequence would need one writer."""
    return F.xxhash64(*columns)


def classify_import(incoming: DataFrame, stored: DataFrame, key_col: str, hash_col: str) -> DataFrame:
    """``incoming`` with ``change``: ``new``, ``updated`` or ``unchanged`` against what is stored. Stored rows that vanished stay."""
    known = stored.select(F.col(key_col).alias("_key"), F.col(hash_col).alias("_hash"))
    joined = incoming.join(known, F.col(key_col) == F.col("_key"), "left")
    change = F.when(F.col("_key").isNull(), "new").when(~F.col(hash_col).eqNullSafe(F.col("_hash")), "updated").otherwise("unchanged")
    return joined.withColumn("change", change).drop("_key", "_hash")


def import_delta(incoming: DataFrame, stored: DataFrame, key_col: str, hash_col: str) -> DataFrame:
    """The rows that an import has to write."""
    return classify_import(incoming, stored, key_col, hash_col).where("change <> 'unchanged'")


def beyond_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The rows of each key beyond its ``keep`` newest: what retention deletes."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") > keep).drop("_place")


def glob_pattern(glob: str) -> str:
    """A file-name pattern (``*``, ``?``, ``[...]``, ``[!...]``) as a case-insensitive regular expression for whole names."""
    parts = re.split(r"(\*|\?|\[!?[^\]]+\])", glob)
    special = {"*": ".*", "?": "."}
    made = [special.get(p) or ("[" + p[1:-1].replace("!", "^", 1 if p[1] == "!" else 0).replace("\\", r"\\") + "]" if re.fullmatch(r"\[!?[^\]]+\]", p) else re.escape(p)) for p in parts if p]
    return "(?is)^" + "".join(made) + "$"


def glob_match(df: DataFrame, name_col: str, globs: Sequence[str]) -> DataFrame:
    """(glob, name): names that a pattern matches; a pattern without wildcards passes through, matched or not."""
    spark = df.sparkSession
    wild = [g for g in globs if re.search(r"[*?\[\]]", g)]
    names = df.select(F.col(name_col).alias("name")).distinct()
    found = spark.createDataFrame([(g, g) for g in globs if g not in wild], "glob string, name string")
    for g in wild:
        found = found.union(names.where(F.col("name").rlike(glob_pattern(g))).select(F.lit(g), "name"))
    return found


def exclude_protected(df: DataFrame, name_col: str, protected: DataFrame, protected_col: str) -> DataFrame:
    """Rows whose name isn't protected, whatever its case."""
    guarded = protected.select(F.lower(protected_col).alias("_name")).distinct()
    return df.join(guarded, F.lower(name_col) == F.col("_name"), "left_anti")


def first_non_null(df: DataFrame, keys: Sequence[str], value_col: str, order_col: str) -> DataFrame:
    """The first value, in order, that isn't null."""
    return df.where(F.col(value_col).isNotNull()).groupBy(*keys).agg(F.min_by(value_col, order_col).alias(value_col))


def reorder(items: DataFrame, position_col: str, order: Sequence[int]) -> DataFrame:
    """Items in the order of a list of positions; positions that don't exist are dropped, repeated ones repeat."""
    wanted = items.sparkSession.createDataFrame(list(enumerate(order)), "place int, wanted long")
    return items.join(F.broadcast(wanted), F.col(position_col) == F.col("wanted")).drop("wanted").orderBy("place")


def without_ignored(files: DataFrame, path_col: str, *, directories: Sequence[str] = (), suffixes: Sequence[str] = (), substrings: Sequence[str] = ()) -> DataFrame:
    """Files outside ignored directories, without ignored suffixes, and without ignored substrings in their path."""
    path = F.col(path_col)
    keep = F.lit(True)
    for d in directories:
        keep = keep & ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit(d)))
    for s in suffixes:
        keep = keep & ~F.lower(path).endswith(s.lower())
    for s in substrings:
        keep = keep & ~F.contains(path, F.lit(s))
    return files.where(keep)


def map_reduce(items: DataFrame, mapped: Column, keys: Sequence[str] = (), name: str = "total") -> DataFrame:
    """A function of every row, summed (for each of ``keys``): a map and a combine, in one pass."""
    return items.select(*keys, mapped.alias("_x")).groupBy(*keys).agg(F.sum("_x").alias(name))
