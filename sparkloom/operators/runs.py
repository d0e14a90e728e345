"""Analytics over ``task_runs(run_id, name, status, attempts, started_at, finished_at, duration, ...)`` and ``task_edges``.

All operators are by ``run_id``, so runs are worked on in parallel; stamps may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graphs, scans


def seconds(stamp: str | Column) -> Column:
    """A timestamp of any kind as seconds."""
    column = F.col(stamp) if isinstance(stamp, str) else stamp
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def elapsed(begin: str | Column, end: str | Column) -> Column:
    """Seconds from one stamp to another, taken from whole microseconds."""
    a, b = (F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp")) for x in (begin, end))
    return (b - a) / F.lit(1e6)


def duration(runs: DataFrame) -> DataFrame:
    """Add ``duration`` from the stamps; null if either is missing."""
    return runs.withColumn("duration", elapsed("started_at", "finished_at"))


def durations(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "name", F.coalesce("duration", F.lit(0.0)).alias("duration"))


def summary(runs: DataFrame) -> DataFrame:
    """(run_id, status, n, total_duration), rounded to microseconds."""
    return runs.groupBy("run_id", "status").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 6).alias("total_duration"))


def by_status(runs: DataFrame, *statuses: str) -> DataFrame:
    return runs.where(F.col("status").isin(*statuses))


def wall_clock(runs: DataFrame) -> DataFrame:
    """(run_id, wall): last finish less first start, over all runs that have stamps; 0 without."""
    return runs.groupBy("run_id").agg(F.coalesce(elapsed(F.min("started_at"), F.max("finished_at")), F.lit(0.0)).alias("wall"))


def wait_times(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, name, wait): start less the latest finish of the hard needs, not below 0; 0 without needs, start, or when skipped."""
    ends = runs.select("run_id", F.col("name").alias("src"), F.col("finished_at").alias("end"))
    ready = graphs.hard(edges).join(ends, ["run_id", "src"]).groupBy("run_id", F.col("dst").alias("name")).agg(F.max("end").alias("ready"))
    wait = F.when(F.col("status") == "skipped", 0.0).otherwise(F.greatest(F.lit(0.0), elapsed("ready", "started_at")))
    return runs.join(ready, ["run_id", "name"], "left").select("run_id", "name", F.coalesce(wait, F.lit(0.0)).alias("wait"))


def parallelism(spans: DataFrame, by: list[str] | None = None, rows: int = scans.ROWS) -> DataFrame:
    """Peak and average of how many spans (``begin``, ``end`` in seconds) are open at once, for each of ``by``.

    Ends come before begins at the same moment; spans without length don't count. The average is the spans' total over
    the time from the first begin to the last end. Changes are summed for each moment first, so a moment at which a
    great many spans begin is one row; moments are swept in parts of about so many ``rows``, so a run may hold all spans.
    """
    by = by or ["run_id"]
    open_ = spans.where(F.col("end") > F.col("begin"))
    change = lambda at, by_one: F.struct(F.col(at).alias("at"), F.lit(by_one).alias("change"))
    points = open_.select(*by, F.explode(F.array(change("begin", 1), change("end", -1))).alias("p")).select(*by, "p.at", "p.change")
    peaks = scans.peaks(points, by, "at", F.col("change"), rows)
    totals = open_.groupBy(*by).agg(F.sum(F.col("end") - F.col("begin")).alias("area"), F.min("begin").alias("first"), F.max("end").alias("last"))
    return peaks.join(totals, by).select(*by, "peak", (F.col("area") / (F.col("last") - F.col("first"))).alias("average"))


def run_spans(runs: DataFrame) -> DataFrame:
    return runs.where("status <> 'skipped'").select("run_id", seconds("started_at").alias("begin"), seconds("finished_at").alias("end"))


def bottlenecks(runs: DataFrame, n: int) -> DataFrame:
    """The n longest tasks of each run; ties by name; none if n is not above 0."""
    order = Window.partitionBy("run_id").orderBy(F.desc("duration"), "name")
    ranked = durations(runs).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= max(n, 0))


def as_graph(runs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return runs.withColumnRenamed("run_id", "graph"), edges.withColumnRenamed("run_id", "graph")


def critical_path(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, total, path) over durations; runs whose tasks all lie on or behind a cycle have none."""
    return graphs.critical_path(*as_graph(runs, edges), "duration").withColumnRenamed("graph", "run_id")


def profile(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each task: status, duration, attempts, wait, hard needs and whether it is on the critical path."""
    needs = graphs.hard(edges).groupBy("run_id", F.col("dst").alias("name")).agg(F.array_sort(F.collect_list(F.struct("pos", "src"))).alias("n"))
    path = graphs.critical_nodes(*as_graph(runs, edges), "duration").select(F.col("graph").alias("run_id"), "name", F.lit(True).alias("critical"))
    joined = runs.join(wait_times(runs, edges), ["run_id", "name"]).join(needs, ["run_id", "name"], "left").join(path, ["run_id", "name"], "left")
    return joined.select(
        "run_id", "name", "status", F.coalesce("duration", F.lit(0.0)).alias("duration"), "attempts", "wait", F.coalesce(F.col("n.src"), F.array().cast("array<string>")).alias("needs"),
        F.coalesce("critical", F.lit(False)).alias("critical"),
    )


def run_profile(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each run: wall, critical, efficiency (critical / wall, 0 for no wall), peak and average parallelism, waits."""
    totals = graphs.heaviest(*as_graph(runs, edges), "duration")
    critical = totals.groupBy(F.col("graph").alias("run_id")).agg(F.max("total").alias("critical"))
    waits = wait_times(runs, edges).groupBy("run_id").agg(F.sum("wait").alias("waiting"))
    joined = wall_clock(runs).join(critical, "run_id", "left").join(parallelism(run_spans(runs)), "run_id", "left").join(waits, "run_id", "left")
    share = F.when(F.col("wall") > 0, F.coalesce("critical", F.lit(0.0)) / F.col("wall")).otherwise(0.0)
    six = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return joined.select("run_id", six("wall"), six("critical"), F.round(share, 4).alias("efficiency"), F.coalesce("peak", F.lit(0)).alias("peak"), F.round(F.coalesce("average", F.lit(0.0)), 4).alias("average"), six("waiting"))


def gantt(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Bars rebuilt from durations and waits: a task begins when its last need ends, plus its wait.

    (run_id, name, begin, end, left_pct, width_pct), scaled to the whole of its run.
    """
    waits = wait_times(runs, edges)
    nodes = runs.join(waits, ["run_id", "name"]).withColumn("span", F.coalesce("duration", F.lit(0.0)) + F.col("wait")).withColumnRenamed("run_id", "graph")
    ends = graphs.heaviest(nodes, edges.withColumnRenamed("run_id", "graph"), "span").select(F.col("graph").alias("run_id"), "name", F.col("total").alias("end"))
    bars = ends.join(durations(runs), ["run_id", "name"]).withColumn("begin", F.col("end") - F.col("duration"))
    whole = bars.groupBy("run_id").agg(F.min("begin").alias("first"), (F.max("end") - F.min("begin")).alias("whole"))
    bars = bars.join(whole, "run_id")
    pct = lambda c: F.coalesce(F.try_divide(c, F.col("whole")) * 100, F.lit(0.0))
    return bars.select("run_id", "name", "begin", "end", F.round(pct(F.col("begin") - F.col("first")), 4).alias("left_pct"), F.round(pct(F.col("end") - F.col("begin")), 4).alias("width_pct"))
