"""What would run, when and how often: the rules of task execution as tables.

Spark is the scheduler; these operators answer, for any number of graphs at once, what a runner has to know: which nodes
are skipped, in which order and in which waves the others go, when attempts are made, what is already stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import chains, graphs, scans
from sparkloom.operators.graphs import KEY

SATISFIED = ("success", "cached")


def skip_propagation(statuses: DataFrame, edges: DataFrame) -> DataFrame:
    """``statuses(graph, name, status, tolerant)`` with status ``skipped`` and the nearest cause for all that can't run.

    A node whose hard need is skipped or failed is skipped itself, unless it is ``tolerant``; a cached need is met.
    Returns (graph, name, status, cause). Chains are walked in one step (``chains.nearest``).
    """
    stopped = F.col("status").isin("skipped", "failed")
    nodes = statuses.select(*KEY, "status", F.lit(0.0).alias("weight"), stopped.alias("start"), (F.coalesce("tolerant", F.lit(False)) & ~stopped).alias("closed"))
    made = chains.nearest(nodes, graphs.hard(edges).select("graph", "src", "dst", F.lit(0).alias("pos")))
    hit = F.col("dist") > 0
    return made.select(*KEY, F.when(hit, "skipped").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("before")).cast("string").alias("cause"))


def dispatch_order(nodes: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Add ``place``: the order inside a layer, by priority (highest first), then name."""
    order = Window.partitionBy(*(within or ["graph", "layer"])).orderBy(F.desc_nulls_last("priority"), "name")
    return nodes.withColumn("place", F.row_number().over(order))


def waves(nodes: DataFrame, limits: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Add ``wave``: how many rounds of its concurrency group go before a node.

    ``limits(concurrency_key, allowed)`` says how many of a group may run together; a key that isn't listed allows one,
    and nodes without a key are all in wave 0.
    """
    joined = nodes.join(limits, "concurrency_key", "left")
    order = Window.partitionBy(*(within or ["graph", "layer"]), "concurrency_key").orderBy(F.desc_nulls_last("priority"), "name")
    wave = F.floor((F.row_number().over(order) - 1) / F.coalesce("allowed", F.lit(1))).cast("int")
    return joined.withColumn("wave", F.when(F.col("concurrency_key").isNull(), 0).otherwise(wave)).drop("allowed")


def retry_schedule(policies: DataFrame, jitter: Column | None = None) -> DataFrame:
    """Attempts of ``policies(..., max_attempts, delay, backoff)``: adds attempt, wait and starts_after (seconds).

    The wait before attempt n + 1 is ``delay * backoff ^ (n - 1)``, plus ``jitter`` if given.
    """
    keys = policies.columns
    tried = policies.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.greatest("max_attempts", F.lit(1)))))
    wait = F.when(F.col("attempt") > 1, F.col("delay") * F.pow("backoff", F.col("attempt") - 2) + (F.lit(0.0) if jitter is None else jitter)).otherwise(0.0)
    order = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return tried.withColumn("wait", wait).withColumn("starts_after", F.sum("wait").over(order))


def settle_attempts(attempts: DataFrame) -> DataFrame:
    """The outcome of each node from its ``attempts(graph, name, attempt, ok, retryable, max_attempts)``.

    Attempts count up to the first that succeeds or can't be retried, and no further than ``max_attempts``.
    """
    stop = Window.partitionBy(KEY).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("ok") | ~F.col("retryable")).over(stop), F.lit(False))
    made = attempts.withColumn("ended", ended).where("NOT ended AND attempt <= max_attempts")
    return made.groupBy(KEY).agg(F.max("attempt").alias("attempts"), F.when(F.max("ok"), "success").otherwise("failed").alias("status"))


def timed_out(runs: DataFrame) -> DataFrame:
    """Add ``timed_out``: whether a run took longer than its ``timeout`` (null: no limit)."""
    return runs.withColumn("timed_out", F.coalesce(F.col("duration") > F.col("timeout"), F.lit(False)))


def unmet_conditions(checks: DataFrame, shown: int = 2) -> DataFrame:
    """Nodes of ``checks(graph, name, label, holds)`` that a condition holds back: (graph, name, n_unmet, reason).

    Conditions are a conjunction; one that couldn't be evaluated (null) isn't met. The reason names the first labels.
    """
    unmet = checks.where(~F.coalesce("holds", F.lit(False))).groupBy(KEY).agg(F.count("*").alias("n_unmet"), F.array_sort(F.collect_set("label")).alias("labels"))
    return unmet.select(*KEY, "n_unmet", F.array_join(F.slice("labels", 1, shown), ", ").alias("reason"))


def soft_inputs(needs: DataFrame, values: DataFrame, defaults: DataFrame) -> DataFrame:
    """``needs(name, src)`` with the value of each soft need: what it gave, else its default, else null."""
    given = needs.join(values.select(F.col("name").alias("src"), "value"), "src", "left")
    return given.join(defaults.withColumnRenamed("value", "fallback"), ["name", "src"], "left").select("name", "src", F.coalesce("value", "fallback").alias("value"))


def storage_key(name: Column, cache_key: Column) -> Column:
    """``name``, or ``name:key`` where there is a cache key."""
    return F.concat_ws(":", name, cache_key)


def live_state(state: DataFrame, now: Column, ttl: Column | float | None) -> DataFrame:
    """Entries of ``state(key, ..., ts)`` that haven't expired: expired is older than ``ttl`` seconds, strictly. Null: never."""
    if ttl is None:
        return state
    limit = F.lit(ttl) if isinstance(ttl, (int, float)) else ttl
    return state.where(limit.isNull() | (now.cast("double") - F.col("ts").cast("double") <= limit))


def resume_pending(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """Nodes, with their ``key``, that no live entry answers and that have to run."""
    return nodes.join(live.select("key").distinct(), "key", "left_anti")


def event_log(runs: DataFrame, rows: int = scans.ROWS) -> DataFrame:
    """Events of runs, each once: ``running`` for those that started, then the final status; numbered within each run.

    A run may hold all events: it is numbered in parts of about so many ``rows``.
    """
    keyed = runs.select("run_id", "name", "status", "attempts", "error", "duration", "reason", "started_at", "finished_at")
    began = keyed.where("started_at IS NOT NULL AND status <> 'skipped'")
    first = began.select("run_id", "name", F.lit("running").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("duration"), F.lit(None).cast("string").alias("reason"), F.col("started_at").alias("ts"))
    last = keyed.where("status <> 'pending'").select("run_id", "name", "status", "attempts", "error", "duration", "reason", F.coalesce("finished_at", "started_at").alias("ts"))
    rank = F.when(F.col("status") == "running", 0).otherwise(1)
    numbered = scans.running(first.unionByName(last).withColumn("rank", rank), ["run_id"], ["ts", "rank", "name"], place="seq", rows=rows)
    return numbered.withColumn("seq", F.col("seq").cast("int")).drop("rank")
