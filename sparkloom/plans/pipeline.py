"""Pipelines: steps are functions of lazy DataFrames, and a parameter's name says which step it needs.

A pipeline composes plans; it runs nothing by itself. Catalyst sees all steps from a sink back to its sources as one
query, so filters and columns are pushed through step borders. ``run`` adds what needs a result: conditions on data,
stored results that later runs take up, and a report as a table that the operators in ``operators.runs`` read.
"""

from __future__ import annotations

import contextlib
import datetime
import inspect
import io
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from sparkloom.errors import BindingError, CyclicGraph, DuplicateStep, MissingInput, StepFailed

Condition = Callable[[Mapping[str, Any]], bool]
RUNS = "run_id string, name string, status string, attempts int, started_at timestamp, finished_at timestamp, duration double, error string, reason string, tags array<string>"
EDGES = "run_id string, src string, dst string, kind string, pos int"


EVENTS = "run_id string, name string, status string, attempts int, error string, duration double, reason string, ts timestamp"


class Context(Mapping):
    """Annotates a parameter that gets the results of all needs of a step at once, by their names."""


@dataclass(frozen=True)
class Step:
    """One step. ``soft`` needs may be missing or skipped: they then give their value in ``defaults``, else None.

    ``attempts`` is how often it may be tried, at once one after the other, as long as ``again`` says so of the error: Spark
    repeats failed tasks by itself, and a source that has to be waited for is a matter for whoever starts runs.
    ``measures`` are aggregates by name that Spark works out while the result is first computed (``df.observe``), without a
    job of their own; ``Report.measured`` has them then. ``needs`` are steps it needs besides those that its parameters name; it sees them through a parameter annotated
    ``Context`` or through ``**kwargs``.
    """

    name: str
    fn: Callable[..., Any]
    soft: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    static: Mapping[str, Any] = field(default_factory=dict)
    defaults: Mapping[str, Any] = field(default_factory=dict)
    when: tuple[Condition, ...] = ()
    tags: tuple[str, ...] = ()
    attempts: int = 1
    again: Callable[[Exception], bool] | None = None
    measures: Mapping[str, Column] = field(default_factory=dict)
    tolerate_skips: bool = False
    continue_on_error: bool = False
    store: bool = False  # write the result to the run's state, and take it from there next time
    cache_key: Callable[[Mapping[str, Any]], str] | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a step needs a name")
        if self.attempts < 1:
            raise ValueError("a step needs at least one attempt")


@dataclass(frozen=True)
class Defaults:
    """What steps of a pipeline have where they say nothing themselves."""

    attempts: int = 1
    tags: tuple[str, ...] = ()
    measures: Mapping[str, Column] = field(default_factory=dict)
    tolerate_skips: bool = False
    continue_on_error: bool = False
    store: bool = False


def step(fn: Callable | None = None, /, **options: Any) -> Any:
    """Make a function a step named after it: ``@step`` or ``@step(soft=("extra",), store=True)``."""
    if fn is None:
        return lambda f: step(f, **options)
    return Step(options.pop("name", fn.__name__), fn, **options)


def template(fn: Callable, **options: Any) -> Callable[..., Step]:
    """A factory of steps that share a function: ``template(load, tags=("io",))("load_orders", static={...})``."""
    return lambda name, **more: Step(name, fn, **(options | more))


def each(name: str, fn: Callable, items: Iterable[Any], parameter: str = "item", gather: Callable[[dict[str, Any]], Any] | None = None, **options: Any) -> list[Step]:
    """A step ``name_k`` for each item, which ``fn`` gets as its ``parameter``, and a step ``name`` with the results of all.

    ``gather`` makes one result of them, by step (of those that weren't skipped); without it rows are put together. Spark
    sees the parts of a union as one query: for items that are rows, use a join instead.
    """
    parts = [Step(f"{name}_{k}", fn, static={parameter: item}, **options) for k, item in enumerate(items)]

    def together(**given: Any) -> Any:
        there = {n: v for n, v in given.items() if v is not None}
        return gather(there) if gather else reduce(DataFrame.unionByName, there.values()) if there else None

    return [*parts, Step(name, together, needs=tuple(p.name for p in parts), tolerate_skips=True)]


def in_turn(*steps: Step) -> list[Step]:
    """Steps that each need the one before, besides what their parameters name."""
    return [s if not k else replace(s, needs=(*s.needs, steps[k - 1].name)) for k, s in enumerate(steps)]


def sql_step(name: str, query: str, needs: Iterable[str], **options: Any) -> Step:
    """A step in SQL text; the steps it needs are what ``{name}`` stands for in the text."""
    needs = tuple(needs)

    def run_sql(spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        return spark.sql(query, **inputs)

    run_sql.__signature__ = inspect.Signature([inspect.Parameter(p, inspect.Parameter.POSITIONAL_OR_KEYWORD) for p in ("spark", *needs)])
    return Step(name, run_sql, **options)


def non_empty(need: str) -> Condition:
    """Holds if a step gave rows (one small job: Spark stops at the first row)."""
    return lambda inputs: inputs.get(need) is not None and not inputs[need].isEmpty()


def first_value(need: str, test: Callable[[Any], bool]) -> Condition:
    """Holds if the first column of a one-row result passes a test."""

    def holds(inputs: Mapping[str, Any]) -> bool:
        row = inputs[need].first() if inputs.get(need) is not None else None
        return row is not None and bool(test(row[0]))

    return holds


def present(need: str) -> Condition:
    return lambda inputs: inputs.get(need) is not None


def negate(condition: Condition) -> Condition:
    return lambda inputs: not condition(inputs)


def any_of(*conditions: Condition) -> Condition:
    return lambda inputs: any(c(inputs) for c in conditions)


def all_of(*conditions: Condition) -> Condition:
    return lambda inputs: all(c(inputs) for c in conditions)


@dataclass
class Report:
    """What a run did: a row for each step, and each step's DataFrame."""

    run_id: str
    rows: list[dict]
    values: dict[str, Any]
    edges: list[tuple]
    events: list[dict] = field(default_factory=list)
    observed: dict[str, Observation] = field(default_factory=dict)

    def measured(self, name: str) -> dict[str, Any]:
        """A step's ``measures``: waits for the first action on its result."""
        return self.observed[name].get

    def __getitem__(self, name: str) -> Any:
        return self.values[name]

    def row(self, name: str) -> dict:
        return next(r for r in self.rows if r["name"] == name)

    def status(self, name: str) -> str:
        return self.row(name)["status"]

    def with_status(self, *statuses: str) -> list[str]:
        return [r["name"] for r in self.rows if r["status"] in statuses]

    def to_dict(self) -> dict:
        """Plain values, seconds rounded to microseconds."""
        keys = ("status", "attempts", "reason", "error")
        return {"run_id": self.run_id, "steps": {r["name"]: {k: r.get(k) for k in keys} | {"duration": round(r.get("duration") or 0.0, 6)} for r in self.rows}}

    def describe(self) -> str:
        lines = [f"  {r['name']}: {r['status']}, {r.get('duration') or 0.0:.3f} s" + (f" ({r['reason']})" if r.get("reason") else "") for r in self.rows]
        return "\n".join([f"run {self.run_id}: {len(self.rows)} steps", *lines])

    def runs(self, spark: SparkSession) -> DataFrame:
        """``task_runs``: one row for each step."""
        return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in RUNS.split(", ")) for r in self.rows], RUNS)

    def task_events(self, spark: SparkSession) -> DataFrame:
        """``task_events``: running and the final status of each step, each once, as the operators in ``streaming`` read them."""
        return spark.createDataFrame([tuple(e.get(c.split()[0]) for c in EVENTS.split(", ")) for e in self.events], EVENTS)

    def run_edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.run_id, *e) for e in self.edges], EDGES)


def _takes_all(p: inspect.Parameter) -> bool:
    """Whether a parameter is annotated as the mapping of all needs: ``Context`` or any ``Mapping``, by the class or by its name."""
    named = p.annotation if isinstance(p.annotation, str) else getattr(p.annotation, "__name__", "")
    return named.partition("[")[0].rpartition(".")[2] in ("Context", "Mapping")


class Pipeline:
    """A set of steps. A parameter called ``spark`` gets the session; one named in ``static`` gets that value."""

    def __init__(self, *steps: Step, defaults: Defaults | None = None) -> None:
        self.steps: dict[str, Step] = {}
        self.defaults = defaults
        for s in steps:
            if s.name in self.steps:
                raise DuplicateStep(s.name)
            self.steps[s.name] = s
        for s in self.steps.values():
            for need in (*s.soft, *s.needs):
                if need not in self.steps:
                    raise MissingInput(f"{s.name} needs {need}")
            self._needs(s)
        self.order = self._order()

    def resolved(self, name: str) -> Step:
        """A step with the pipeline's defaults where its own fields are as they come."""
        s, plain = self.steps[name], Step("plain", lambda: None)
        if self.defaults is None:
            return s
        return replace(s, **{f.name: getattr(self.defaults, f.name) for f in fields(Defaults) if getattr(s, f.name) == getattr(plain, f.name)})

    def _needs(self, s: Step) -> dict[str, str]:
        """Steps it needs, and whether hard or soft."""
        out: dict[str, str] = {}
        rest = False
        for p in inspect.signature(s.fn).parameters.values():
            if p.name in s.static:
                if p.name in self.steps:
                    raise BindingError(f"{s.name}: {p.name} is a step and a static value")
            elif p.name in self.steps and p.name != s.name:
                out[p.name] = "soft" if p.name in s.soft else "hard"
            elif p.kind is p.VAR_KEYWORD or _takes_all(p):
                rest = True
            elif p.name != "spark" and p.default is p.empty:
                raise BindingError(f"{s.name}: nothing is called {p.name}")
        if rest:
            out |= {n: "soft" for n in s.soft if n not in out}
        return out | {n: "hard" for n in s.needs if n not in out}

    def _order(self) -> list[str]:
        try:
            return list(TopologicalSorter({n: self._needs(s) for n, s in self.steps.items()}).static_order())
        except CycleError as e:
            raise CyclicGraph(e.args[1]) from e

    def edges(self) -> list[tuple[str, str, str, int]]:
        return [(src, n, kind, pos) for n in self.order for pos, (src, kind) in enumerate(self._needs(self.steps[n]).items())]

    def layers(self) -> list[list[str]]:
        """Steps that could run at the same time, by name: one more than the highest layer of their hard needs."""
        at: dict[str, int] = {}
        sorter = TopologicalSorter({n: [x for x, kind in self._needs(s).items() if kind == "hard"] for n, s in self.steps.items()})
        for n in sorter.static_order():
            at[n] = 1 + max((at[x] for x, kind in self._needs(self.steps[n]).items() if kind == "hard"), default=-1)
        return [sorted(n for n in at if at[n] == k) for k in range(max(at.values(), default=-1) + 1)]

    def bindings(self) -> list[tuple[str, str, str, str]]:
        """(step, parameter, source, kind), sorted: what every value comes from. Kinds are hard and soft (needs), static and session."""
        asked = {n: set(inspect.signature(s.fn).parameters) for n, s in self.steps.items()}
        needs = {(dst, src if src in asked[dst] else "(all needs)", src, kind) for src, dst, kind, _ in self.edges()}
        static = {(n, key, str(value), "static") for n, s in self.steps.items() for key, value in s.static.items()}
        return sorted(needs | static | {(n, "spark", "spark", "session") for n, names in asked.items() if "spark" in names - set(self.steps[n].static)})

    def dry_run(self, spark: SparkSession | None = None) -> str:
        """What a run would do, without doing it: layers and bindings; with a session, the plans of the last steps too."""
        lines, told = [f"{len(self.steps)} steps in {len(self.layers())} layers"], self.bindings()
        for k, layer in enumerate(self.layers(), 1):
            lines += [f"layer {k}", *(f"  {n}: " + ", ".join(f"{p} from {source} ({kind})" for step_, p, source, kind in told if step_ == n) for n in layer)]
        used = {src for src, *_ in self.edges()}
        for n in [n for n in self.order if n not in used] if spark is not None else []:
            made = self.plan(spark, n)
            if isinstance(made, DataFrame):
                with contextlib.redirect_stdout(io.StringIO()) as text:
                    made.explain("formatted")
                lines += [f"plan of {n}", text.getvalue()]
        return "\n".join(lines)

    def merged(self, namespace: str, other: Pipeline) -> Pipeline:
        """This pipeline and another one, whose steps are renamed ``namespace_<name>``; their parameters follow."""
        renamed = {n: f"{namespace}_{n}" for n in other.steps}

        def moved(s: Step) -> Step:
            old = inspect.signature(s.fn)
            fn = lambda **given: s.fn(**{back.get(k, k): v for k, v in given.items()})
            back = {new: was for was, new in renamed.items()}
            fn.__signature__ = old.replace(parameters=[p.replace(name=renamed.get(p.name, p.name)) if p.name not in s.static else p for p in old.parameters.values()])
            names = lambda given: tuple(renamed[n] for n in given)
            return replace(s, name=renamed[s.name], fn=fn, soft=names(s.soft), needs=names(s.needs), defaults={renamed[n]: v for n, v in s.defaults.items()})

        return Pipeline(*(self.resolved(n) for n in self.steps), *(moved(other.resolved(n)) for n in other.steps))

    def only(self, *names: str, tags: Iterable[str] = ()) -> Pipeline:
        """The named or tagged steps and all that they need."""
        tags = set(tags)
        wanted = [n for n, s in self.steps.items() if n in names or tags & set(s.tags)]
        if unknown := set(names) - set(self.steps):
            raise KeyError(sorted(unknown)[0])
        kept: set[str] = set()
        while wanted:
            if (n := wanted.pop()) not in kept:
                kept.add(n)
                wanted += self._needs(self.steps[n])
        return Pipeline(*(s for n, s in self.steps.items() if n in kept), defaults=self.defaults)

    def tables(self, spark: SparkSession, graph: str = "pipeline") -> tuple[DataFrame, DataFrame]:
        """Nodes and edges for the operators in ``operators.graphs``."""
        nodes = spark.createDataFrame([(graph, n, list(self.steps[n].tags)) for n in self.order], "graph string, name string, tags array<string>")
        return nodes, spark.createDataFrame([(graph, *e) for e in self.edges()], EDGES.replace("run_id", "graph"))

    def plan(self, spark: SparkSession, name: str) -> DataFrame:
        """One step's lazy DataFrame; only what it needs is composed, conditions aren't asked."""
        values: dict[str, Any] = {}
        for n in self.only(name).order:
            values[n] = self._call(spark, self.steps[n], values)
        return values[name]

    def _inputs(self, s: Step, values: Mapping[str, Any]) -> dict[str, Any]:
        return {n: s.defaults.get(n) if values.get(n) is None and kind == "soft" else values.get(n) for n, kind in self._needs(s).items()}

    def _call(self, spark: SparkSession, s: Step, values: Mapping[str, Any]) -> Any:
        given, inputs = dict(s.static), self._inputs(s, values)
        for p in inspect.signature(s.fn).parameters.values():
            if p.kind is p.VAR_KEYWORD:
                given |= inputs
            elif p.name in inputs:
                given[p.name] = inputs[p.name]
            elif p.name == "spark":
                given["spark"] = spark
            elif p.name not in given and _takes_all(p):
                given[p.name] = dict(inputs)
        return s.fn(**given)

    def run(self, spark: SparkSession, state: Any = None, listener: Callable[[dict], None] | None = None) -> Report:
        """Compose every step in order; ask conditions; store and resume those that say so.

        ``listener`` gets each event as it happens: a step's status ``running``, then its final one, each once.

        A step is skipped if a condition doesn't hold (one that raises doesn't), or if a hard need was skipped or
        failed; a stored result counts as met. Results that aren't stored stay lazy: their cost, and any error in their
        data, comes with the first action on them.
        """
        report = Report(uuid.uuid4().hex, [], {}, self.edges())
        status: dict[str, str] = {}

        def tell(row: dict, **more: Any) -> None:
            event = {c.split()[0]: row.get(c.split()[0]) for c in EVENTS.split(", ")} | {"ts": datetime.datetime.now(datetime.timezone.utc)} | more
            report.events.append(event)
            if listener is not None:
                listener(event)

        try:
            for n in self.order:
                s = self.resolved(n)
                row = {"run_id": report.run_id, "name": n, "tags": list(s.tags), "started_at": datetime.datetime.now(datetime.timezone.utc), "attempts": 0}
                self._settle(spark, s, state, report, status, row, lambda row=row: tell(row, status="running"))
                row["finished_at"] = datetime.datetime.now(datetime.timezone.utc)
                row["duration"] = (row["finished_at"] - row["started_at"]).total_seconds()
                status[n] = row["status"]
                report.rows.append(row)
                tell(row)
                if row["status"] == "failed" and not s.continue_on_error:
                    raise StepFailed(n, row["attempts"], report) from row["cause"]
        finally:
            if state is not None:
                state.commit()
        return report

    def _settle(self, spark: SparkSession, s: Step, state: Any, report: Report, status: dict[str, str], row: dict, begin: Callable[[], None]) -> None:
        values = report.values
        inputs = self._inputs(s, values)
        key = s.name if s.cache_key is None else f"{s.name}:{s.cache_key(inputs)}"
        held = state.load(key) if state is not None and s.store else None
        if held is not None:
            values[s.name] = held
            row |= {"status": "cached", "reason": "stored"}
            return
        bad = [n for n, kind in self._needs(s).items() if kind == "hard" and status[n] in ("skipped", "failed")]
        if bad and not s.tolerate_skips:
            row |= {"status": "skipped", "reason": f"{bad[0]} is {status[bad[0]]}"}
            return
        for condition in s.when:
            try:
                met = condition(inputs)
            except Exception:  # a condition that can't be asked isn't met
                met = False
            if not met:
                row |= {"status": "skipped", "reason": "condition"}
                return
        begin()
        while row.get("status") is None:
            row["attempts"] += 1
            try:
                made = self._call(spark, s, values)
                if s.measures and isinstance(made, DataFrame):
                    report.observed[s.name] = Observation(s.name)
                    made = made.observe(report.observed[s.name], *[e.alias(n) for n, e in s.measures.items()])
                values[s.name] = state.save(key, made) if state is not None and s.store else made
                row["status"] = "success"
            except Exception as e:
                if row["attempts"] >= s.attempts or (s.again is not None and not s.again(e)):
                    row |= {"status": "failed", "error": str(e)[:2000], "cause": e}
