"""Runs watched live: equal to the table of all events, through restarts, late and repeated events."""

from __future__ import annotations

import datetime as dt
import random

from conftest import rows

from sparkloom.streaming import live, task_events

START = dt.datetime(2024, 1, 1)


def event(task, seq, status, minute, run="r"):
    return (run, seq, task, status, 1, None, None, None, START + dt.timedelta(minutes=minute))


def arrive(spark, path, batch):
    spark.createDataFrame(batch, task_events.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")


def watched(spark, path, **more):
    """All that has arrived is taken up, and the stream ends; the next call goes on from its checkpoint."""
    made = live.watch(task_events.read_events(spark, f"{path}/in"), **more).writeStream.outputMode("update")
    made = made.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    made.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/out/batch={k}")).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def states(changes):
    return {r["task"]: (r["seq"], r["status"], r["events"], r["stuck"]) for r in live.current(changes).collect()}


def test_stuck_tasks_are_told_and_released(spark, tmp_path):
    arrive(spark, tmp_path, [event("a", 1, "running", 0), event("b", 2, "running", 1), event("b", 3, "success", 2)])
    assert states(watched(spark, tmp_path)) == {"a": (1, "running", 1, False), "b": (3, "success", 2, False)}
    arrive(spark, tmp_path, [event("c", 4, "running", 100)])
    assert states(watched(spark, tmp_path)) == {"a": (1, "running", 1, True), "b": (3, "success", 2, False), "c": (4, "running", 1, False)}
    arrive(spark, tmp_path, [event("a", 5, "success", 101)])
    changes = watched(spark, tmp_path)
    assert states(changes)["a"] == (5, "success", 2, False)
    assert changes.where("stuck").count() == 1  # told once
    before = changes.count()
    assert watched(spark, tmp_path).count() == before  # a restart without new events repeats nothing


def test_ended_tasks_are_forgotten(spark, tmp_path):
    arrive(spark, tmp_path, [event("a", 7, "success", 0)])
    watched(spark, tmp_path, keep=600)
    arrive(spark, tmp_path, [event("b", 8, "running", 60)])
    watched(spark, tmp_path, keep=600)
    arrive(spark, tmp_path, [event("a", 2, "running", 61)])  # smaller than what is no longer known
    assert watched(spark, tmp_path, keep=600).where("task = 'a' AND seq = 2 AND events = 1").count() == 1


def test_equals_the_table_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    tasks = ["hot"] * 300 + [f"t{k % 23}" for k in range(500)] + [None] * 9
    rng.shuffle(tasks)
    found = [event(t, k, rng.choice(["running", "retry", "success", "failed"]), k / 30, rng.choice(["r", None])) for k, t in enumerate(tasks)]
    found += rng.sample(found, 40)  # delivered twice
    for k in range(0, len(found), 300):
        part = found[k : k + 300]
        rng.shuffle(part)
        arrive(spark, tmp_path, part)
        changes = watched(spark, tmp_path, late="1 hour")
    odd = [("r", None, "x", "running", 1, None, None, None, START), ("r", 1, "y", "running", None, None, None, None, None)]
    arrive(spark, tmp_path, odd)
    changes = watched(spark, tmp_path, late="1 hour")
    table = spark.createDataFrame(found, task_events.EVENTS)
    assert rows(live.current(changes).select("run_id", "task", "status", "attempts")) == rows(task_events.latest_status(table))
    assert live.current(changes).selectExpr("sum(events)").first()[0] == len(found)


def test_no_events_no_rows(spark, tmp_path):
    spark.createDataFrame([], task_events.EVENTS).write.parquet(f"{tmp_path}/in")
    arrive(spark, tmp_path, [event("x", None, "running", 0)])
    assert watched(spark, tmp_path).count() == 0
