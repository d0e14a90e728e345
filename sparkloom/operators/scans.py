"""Running values over rows in order, for keys of any size: a prefix scan in parts.

A window over a key sorts all of the key's rows in one task. Here rows are dealt by ranges of key and order, each part
scans its own, and what the parts before it hold of the same key is added: of all keys only the first one of a part goes
on from an earlier part, so no more rows than there are parts are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import scope, written

ROWS = 1_000_000  # of a part, about; a table of no more is one part, which windows over keys answer as well


def running(
    table: DataFrame, by: Sequence[str], order: Sequence[str], *, sums: Mapping[str, Column] | None = None, previous: Mapping[str, str] | None = None,
    latest: Mapping[str, str] | None = None, place: str | None = None, rows: int = ROWS,
) -> DataFrame:
    """Add running values to the rows of each key ``by``, in rising ``order`` (nulls first), which should be total.

    ``sums`` names sums up to and including a row (nulls count as nothing), ``previous`` names columns taken from the row
    before (null for the first), ``latest`` names columns of which the last value that isn't null is taken, up to and
    including a row, ``place`` numbers the rows from 1. Rows with null keys are a key too.
    """
    sums, previous, latest = dict(sums or {}) | ({place: F.lit(1)} if place else {}), dict(previous or {}), dict(latest or {})
    terms, lasts = [f"term {i}" for i in range(len(sums))], [f"last {i}" for i in range(len(previous) + len(latest))]
    with scope() as keep:
        given = keep(written(table.select("*", *[F.coalesce(e, F.lit(0)).alias(t) for t, e in zip(terms, sums.values())]), "scanned"))
        parts = -(-given.count() // rows)
        if parts <= 1:
            placed, own = given.withColumn("scan part", F.lit(0)), Window.partitionBy(*by).orderBy(*order)
        else:
            placed = given.repartitionByRange(parts, *by, *order).withColumn("scan part", F.spark_partition_id())
            placed, own = keep(written(placed, "parts")), Window.partitionBy("scan part", *by).orderBy(*order)
        upto = own.rowsBetween(Window.unboundedPreceding, 0)
        values = [F.sum(t).over(upto).alias(n) for n, t in zip(sums, terms)] + [F.lag(c).over(own).alias(n) for n, c in previous.items()]
        values += [F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in latest.items()]
        first = (F.row_number().over(own) == 1).alias("scan first")
        scanned = placed.select(*table.columns, "scan part", *values, *([first] if previous else []))
        if parts <= 1:
            return scanned.select(*table.columns, *sums, *previous, *latest)
        at_end = [F.max_by(c, F.struct(*order)).alias(n) for n, c in zip(lasts, previous.values())]
        at_end += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(n) for n, c in zip(lasts[len(previous) :], latest.values())]
        ends = placed.groupBy("scan part", *by).agg(*[F.sum(t).alias(t) for t in terms], *at_end, F.count("*").alias("scan rows"))
        earlier = Window.partitionBy(*by).orderBy("scan part")  # no more rows than parts
        before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(
            F.col("scan part").alias("to part"), *[F.col(c).alias(f"to {c}") for c in by], F.count("*").over(before).alias("parts before"),
            *[F.sum(t).over(before).alias(t) for t in terms], *[F.lag(n).over(earlier).alias(n) for n in lasts[: len(previous)]],
            *[F.last(n, ignorenulls=True).over(before).alias(n) for n in lasts[len(previous) :]],
        ).where("`parts before` > 0")
        carried = keep(written(carried, "carried"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"to {c}")) for c in by], F.col("scan part") == F.col("to part"))
        whole = scanned.join(F.broadcast(carried), same, "left")  # a row for each part at most
        total = [(F.col(n) + F.coalesce(t, F.lit(0))).alias(n) for n, t in zip(sums, terms)]
        back = [F.when(F.col("scan first"), F.col(t)).otherwise(F.col(n)).alias(n) for n, t in zip(previous, lasts)]
        kept = [F.coalesce(n, t).alias(n) for n, t in zip(latest, lasts[len(previous) :])]
        return whole.select(*table.columns, *total, *back, *kept)


def peaks(changes: DataFrame, by: Sequence[str], at: str, change: Column, rows: int = ROWS) -> DataFrame:
    """(by, peak): the highest running sum of ``change`` over ``at``; changes of one moment come together."""
    moments = changes.groupBy(*by, at).agg(F.sum(change).alias("change"))
    return running(moments, by, [at], sums={"level": F.col("change")}, rows=rows).groupBy(*by).agg(F.max("level").alias("peak"))
