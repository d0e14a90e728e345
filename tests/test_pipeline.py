"""Pipelines of lazy steps: binding, order, conditions, soft needs, retries, stored results and reports."""

from __future__ import annotations

from collections.abc import Mapping

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparkloom.errors import BindingError, CyclicGraph, DuplicateStep, MissingInput, StateError, StepFailed
from sparkloom.operators import graphs
from sparkloom.operators import runs as run_operators
from sparkloom.plans.pipeline import Context, Defaults, Pipeline, Step, all_of, any_of, each, first_value, in_turn, negate, non_empty, present, sql_step, step, template
from sparkloom.sources.state import SessionState, TableState


@step(tags=("in",))
def numbers(spark, n=5):
    return spark.range(n)


@step
def squares(numbers):
    return numbers.select((F.col("id") * F.col("id")).alias("x"))


@step(tags=("out",))
def total(squares):
    return squares.agg(F.sum("x").alias("total"))


def test_steps_compose_one_lazy_plan(spark):
    p = Pipeline(total, squares, numbers)
    assert p.order == ["numbers", "squares", "total"]
    assert p.plan(spark, "total").first()[0] == 30
    assert p.run(spark)["total"].first()[0] == 30


def test_static_values_defaults_and_templates(spark):
    make = template(lambda spark, n=2: spark.range(n), tags=("made",))
    p = Pipeline(make("two"), make("three", static={"n": 3}), Step("both", lambda two, three: two.union(three)))
    assert p.plan(spark, "both").count() == 5
    assert p.only(tags=["made"]).order == ["two", "three"]


def test_errors_of_wrong_pipelines():
    with pytest.raises(DuplicateStep):
        Pipeline(numbers, numbers)
    with pytest.raises(BindingError):
        Pipeline(squares)
    with pytest.raises(BindingError):
        Pipeline(numbers, Step("x", lambda numbers: numbers, static={"numbers": 1}))
    with pytest.raises(MissingInput):
        Pipeline(Step("x", lambda spark, **more: None, soft=("nowhere",)))
    with pytest.raises(CyclicGraph) as e:
        Pipeline(Step("a", lambda b: b), Step("b", lambda a: a))
    assert set(e.value.path) == {"a", "b"}
    with pytest.raises(ValueError):
        Step("", lambda: None)
    with pytest.raises(ValueError):
        Step("a", lambda: None, attempts=0)
    with pytest.raises(KeyError):
        Pipeline(numbers).only("nothing")


def test_sql_steps_see_what_they_need(spark):
    p = Pipeline(numbers, sql_step("big", "SELECT id FROM {numbers} WHERE id > 2", ["numbers"]))
    assert rows(p.plan(spark, "big")) == [(3,), (4,)]


def test_conditions_skip_a_step_and_what_needs_it(spark):
    none = Step("none", lambda spark: spark.range(0))
    gated = lambda name, *when, **more: Step(name, lambda numbers, none: numbers, when=when, **more)
    p = Pipeline(
        numbers, none, gated("yes", non_empty("numbers"), negate(non_empty("none"))), gated("no", all_of(present("numbers"), non_empty("none"))), gated("either", any_of(non_empty("none"), first_value("numbers", lambda v: v == 0))),
        gated("raises", lambda inputs: 1 / 0), Step("child", lambda no: no), Step("tolerant", lambda no, spark: spark.range(1), tolerate_skips=True),
        Step("soft", lambda no, numbers: numbers if no is None else no, soft=("no",)), Step("fallback", lambda no: no, soft=("no",), defaults={"no": 7}),
    )
    report = p.run(spark)
    assert [report.status(n) for n in ("yes", "no", "either", "raises", "child", "tolerant", "soft", "fallback")] == ["success", "skipped", "success", "skipped", "skipped", "success", "success", "success"]
    assert report["soft"].count() == 5 and report["fallback"] == 7
    assert next(r["reason"] for r in report.rows if r["name"] == "child") == "no is skipped"


def test_attempts_failures_and_reports(spark):
    tries = []

    def flaky(spark):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")
        return spark.range(1)

    report = Pipeline(Step("flaky", flaky, attempts=3)).run(spark)
    assert report.rows[0]["attempts"] == 3 and report.status("flaky") == "success"

    def broken(spark):
        raise RuntimeError("never")

    tolerated = Pipeline(Step("broken", broken, continue_on_error=True), Step("child", lambda broken: broken), numbers).run(spark)
    assert [tolerated.status(n) for n in ("broken", "child", "numbers")] == ["failed", "skipped", "success"]
    with pytest.raises(StepFailed) as e:
        Pipeline(numbers, Step("broken", lambda numbers: broken(None), attempts=2)).run(spark)
    assert e.value.attempts == 2 and e.value.report.status("numbers") == "success" and isinstance(e.value.__cause__, RuntimeError)

    runs = tolerated.runs(spark)
    assert rows(run_operators.summary(runs).select("status", "n")) == [("failed", 1), ("skipped", 1), ("success", 1)]
    assert run_operators.wall_clock(runs).first()["wall"] >= 0
    assert rows(tolerated.run_edges(spark).select("src", "dst", "kind")) == [("broken", "child", "hard")]


def test_stored_results_are_taken_up(spark, tmp_path):
    made = []

    def load(spark):
        made.append(1)
        return spark.range(len(made))

    p = Pipeline(Step("load", load, store=True), Step("child", lambda load: load.agg(F.count("*"))))
    state = TableState(spark, str(tmp_path))
    assert p.run(spark, state)["child"].first()[0] == 1
    again = p.run(spark, TableState(spark, str(tmp_path)))
    assert (again.status("load"), again.status("child"), again["child"].first()[0]) == ("cached", "success", 1)
    state.clear()
    assert p.run(spark, state)["child"].first()[0] == 2
    expired = TableState(spark, str(tmp_path), ttl=-1.0)
    assert expired.load("load") is None


def test_cache_keys_tell_inputs_apart(spark):
    state = SessionState()
    p = lambda n: Pipeline(Step("n", lambda: n), Step("made", lambda n, spark: spark.range(n), store=True, cache_key=lambda inputs: str(inputs["n"])))
    assert [p(n).run(spark, state).status("made") for n in (1, 2, 1)] == ["success", "success", "cached"]
    assert SessionState(ttl=-1.0).load("made:1") is None
    state.clear()
    assert state.load("made:1") is None


def test_state_that_is_no_state(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/manifest")
    with pytest.raises(StateError):
        TableState(spark, str(tmp_path)).load("x")


def test_merged_pipelines_rename_their_steps(spark):
    other = Pipeline(Step("numbers", lambda spark: spark.range(3)), Step("double", lambda numbers: numbers.selectExpr("id * 2 AS id")))
    p = Pipeline(numbers, squares).merged("more", other)
    assert set(p.steps) == {"numbers", "squares", "more_numbers", "more_double"}
    assert rows(p.plan(spark, "more_double")) == [(0,), (2,), (4,)]
    nodes, edges = p.tables(spark)
    assert rows(graphs.layers(nodes, edges).select("name", "layer")) == [("more_double", 1), ("more_numbers", 0), ("numbers", 0), ("squares", 1)]


def test_another_attempt_depends_on_the_error(spark):
    tried = []

    def flaky(spark):
        tried.append(1)
        if len(tried) < 3:
            raise OSError("not there yet")
        return spark.range(1)

    report = Pipeline(Step("flaky", flaky, attempts=5, again=lambda e: isinstance(e, OSError))).run(spark)
    assert report.row("flaky")["attempts"] == 3
    tried.clear()
    with pytest.raises(StepFailed):
        Pipeline(Step("flaky", flaky, attempts=5, again=lambda e: isinstance(e, KeyError))).run(spark)
    assert len(tried) == 1


def test_defaults_fill_only_what_a_step_leaves_open(spark):
    p = Pipeline(numbers, Step("own", lambda spark: spark.range(1), attempts=3), Step("plain", lambda spark: spark.range(1)), defaults=Defaults(attempts=2, tags=("all",), continue_on_error=True))
    assert p.resolved("numbers").tags == ("in",) and p.resolved("plain").tags == ("all",)
    assert p.resolved("own").attempts == 3 and p.resolved("plain").attempts == 2 and p.resolved("own").continue_on_error
    assert p.only("plain").resolved("plain").tags == ("all",)
    assert p.run(spark).row("plain")["tags"] == ["all"]


def test_measures_come_with_the_first_action_and_events_once_each(spark):
    heard = []
    steps = [
        Step("good", lambda spark: spark.range(4), measures={"rows": F.count("*"), "top": F.max("id")}), Step("bad", lambda spark: 1 / 0, attempts=2, continue_on_error=True),
        Step("behind", lambda bad: bad), Step("calm", lambda spark: spark.range(1)),
    ]
    report = Pipeline(*steps).run(spark, listener=heard.append)
    assert report["good"].where("id > 1").count() == 2 and report.measured("good") == {"rows": 4, "top": 3}
    assert heard == report.events
    got = sorted((e["name"], e["status"]) for e in heard)
    assert got == [("bad", "failed"), ("bad", "running"), ("behind", "skipped"), ("calm", "running"), ("calm", "success"), ("good", "running"), ("good", "success")]
    events = report.task_events(spark)
    assert events.count() == 7 and events.where("status = 'failed' AND attempts = 2 AND error IS NOT NULL").count() == 1
    assert report.with_status("failed", "skipped") == ["bad", "behind"] and "behind: skipped" in report.describe()
    assert report.to_dict()["steps"]["bad"]["attempts"] == 2


def test_a_step_for_each_item_and_steps_in_turn(spark):
    made = each("square", lambda numbers, item: numbers.selectExpr(f"id * {item} AS x"), [2, 3])
    p = Pipeline(numbers, *made, Step("top", lambda square: square.agg(F.max("x"))))
    assert [s.name for s in made] == ["square_0", "square_1", "square"] and p.plan(spark, "top").first()[0] == 12
    gated = [Step(s.name, s.fn, static=s.static, when=(lambda inputs, n=s.static.get("item"): n == 2,)) if s.static else s for s in made]
    assert Pipeline(numbers, *gated).run(spark)["square"].count() == 5
    several = each("n", lambda spark, item: spark.range(item), [1, 2], gather=lambda given: {n: df.count() for n, df in given.items()})
    assert Pipeline(*several).run(spark)["n"] == {"n_0": 1, "n_1": 2}
    chain = Pipeline(*in_turn(Step("c", lambda spark: 1), Step("b", lambda spark: 2), Step("a", lambda b, c: b + c)))
    assert chain.order == ["c", "b", "a"] and chain.run(spark)["a"] == 3


def test_a_context_has_all_needs(spark):
    def both(ctx: Context, extra=1):
        return ctx["numbers"].union(ctx["squares"].toDF("id")), sorted(ctx)

    def rest(**given):
        return sorted(given)

    def mapped(given: Mapping[str, object], numbers):
        return sorted(given)

    assert Pipeline(numbers, squares, Step("mapped", mapped, needs=("squares",))).run(spark)["mapped"] == ["numbers", "squares"]

    p = Pipeline(numbers, squares, Step("both", both, needs=("numbers", "squares")), Step("rest", rest, needs=("both",), soft=("numbers",)))
    report = p.run(spark)
    assert report["both"][0].count() == 10 and report["both"][1] == ["numbers", "squares"] and report["rest"] == ["both", "numbers"]
    assert p.bindings()[:3] == [("both", "(all needs)", "numbers", "hard"), ("both", "(all needs)", "squares", "hard"), ("numbers", "spark", "spark", "session")]
    with pytest.raises(MissingInput):
        Pipeline(Step("x", both, needs=("nowhere",)))


def test_a_dry_run_tells_layers_bindings_and_plans(spark):
    ran = []
    late = Step("late", lambda total, numbers: ran.append(1) or total, soft=("numbers",))
    p = Pipeline(numbers, squares, total, late, Step("fixed", lambda spark, n: spark.range(n), static={"n": 7}))
    assert p.layers() == [["fixed", "numbers"], ["squares"], ["total"], ["late"]]
    told = p.dry_run()
    assert "5 steps in 4 layers" in told and "late: numbers from numbers (soft), total from total (hard)" in told and "fixed: n from 7 (static), spark from spark (session)" in told
    assert not ran and "Range" in p.dry_run(spark)


def test_delete_all_keeps_the_columns(spark, tmp_path):
    from sparkloom.sources.files import delete_all

    spark.range(5).withColumn("x", F.lit("a")).write.parquet(f"{tmp_path}/t")
    delete_all(spark, f"{tmp_path}/t")
    left = spark.read.parquet(f"{tmp_path}/t")
    assert left.columns == ["id", "x"] and left.count() == 0
