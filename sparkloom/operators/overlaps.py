"""Spans that overlap, and the last of one kind before another: joins on time without comparing all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import scans


def _binned(spans: DataFrame, by: Sequence[str], width: float, side: str) -> DataFrame:
    """Spans as a struct column named ``side``, a row for each bin that they touch, and which bin is their first."""
    first, last = (F.floor(F.col(c) / width) for c in ("begin", "end"))
    kept = spans.where(F.col("begin") < F.col("end"))
    return kept.select(*by, F.struct(*[c for c in spans.columns if c not in by]).alias(side), first.alias(f"{side} first"), F.explode(F.sequence(first, last)).alias("bin"))


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], width: float, pair: Column | None = None) -> DataFrame:
    """(by, left, right): all pairs of spans (``begin``, ``end`` in seconds) of a key that have a moment in common.

    ``left`` and ``right`` are structs of the other columns. Spans are cut into bins of ``width`` seconds and meet where they
    share a bin, so a key with a great many spans is many groups; a pair counts in the first bin that both touch, and is
    compared exactly there. Spans that only touch, and those without length, don't overlap. ``width`` should be near the
    usual length: a span that is n times as long is n rows. ``pair`` restricts pairs, such as each to be told once.
    """
    both = _binned(left, by, width, "left").join(_binned(right, by, width, "right"), [*by, "bin"])
    meets = (F.col("left.begin") < F.col("right.end")) & (F.col("right.begin") < F.col("left.end"))
    once = F.col("bin") == F.greatest("left first", "right first")
    made = both.where(meets & once).select(*by, "left", "right")
    return made if pair is None else made.where(pair)


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str, *, strict: bool = False, name: str = "before", rows: int = scans.ROWS) -> DataFrame:
    """Add to ``left`` the ``value`` of the last row of ``right`` of its key at or (``strict``) before its moment ``at``; else null.

    Both have ``at``; of rows of ``right`` at one moment the largest value counts. The two tables are sorted together by ranges
    of key and moment and scanned in parts (``scans.running``), so nothing is compared twice and a key may hold all rows.
    """
    known = right.where(reduce(and_, [F.col(c).isNotNull() for c in (at, value)])).groupBy(*by, at).agg(F.max(value).alias("as of value"))
    asked = left.select("*", F.lit(None).cast(known.schema["as of value"].dataType).alias("as of value"), F.lit(0 if strict else 2).alias("as of rank"))
    both = asked.unionByName(known.withColumn("as of rank", F.lit(1)), allowMissingColumns=True)
    made = scans.running(both, by, [at, "as of rank"], latest={name: "as of value"}, rows=rows)
    return made.where("`as of rank` <> 1").select(*left.columns, name)
