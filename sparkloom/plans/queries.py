"""The registered queries of the library's own operators, each over whole driver tables, and their DuckDB SQL.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE_SQL`` has SQL that gives the same rows. Task graphs
are made of ``conversations`` (a graph for each conversation, a node for each turn), task runs of ``events`` (a run for
each user) or of ``conversations``; stamps are compared as microseconds, so no time zone plays a part.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import cycles, dispatch, graphs, overlaps, relational, runs
from sparkloom.plans.pipeline import Context, Defaults, Pipeline, Step, all_of, any_of, each, first_value, in_turn, negate, non_empty, present, sql_step, template
from sparkloom.session import counted, shared_dir
from sparkloom.sources import archive, files
from sparkloom.sources.mail import parse_mails
from sparkloom.sources.search_index import TextIndex
from sparkloom.sources.state import TableState
from sparkloom.sources.versioned import VersionedTable
from sparkloom.streaming import live, task_events

PART = 2_000  # rows of a part where tables are scanned in parts, so that small ones are several parts too
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(stamp: str) -> Column:
    return F.unix_micros(F.col(stamp).cast("timestamp"))


# -- extract, transform, load ----------------------------------------------------------------------------------------


def etl_pipeline(sf_dir: str) -> Pipeline:
    """Two sources and a lookup join, as steps bound by their parameters' names."""

    def extract_orders(spark: SparkSession) -> DataFrame:
        return table(spark, sf_dir, "orders")

    def extract_customers(spark: SparkSession) -> DataFrame:
        return table(spark, sf_dir, "customer").where("c_acctbal >= 0")

    def enrich(extract_orders: DataFrame, extract_customers: DataFrame) -> DataFrame:
        return relational.lookup_join(extract_orders, extract_customers, "o_custkey", "c_custkey", {"c_name": "customer_name"})

    def load_count(enrich: DataFrame) -> DataFrame:
        return relational.row_count(enrich)

    by_status = sql_step("by_status", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT customer_name) AS customers FROM {enrich} GROUP BY o_orderstatus", ["enrich"])
    return Pipeline(*(Step(f.__name__, f) for f in (extract_orders, extract_customers, enrich, load_count)), by_status)


_ENRICHED = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_name AS customer_name
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0
"""


@query(_ENRICHED)
def etl_enrich(spark, sf_dir):
    return etl_pipeline(sf_dir).plan(spark, "enrich")


@query(f"SELECT count(*) AS n FROM ({_ENRICHED})")
def etl_load_count(spark, sf_dir):
    return etl_pipeline(sf_dir).plan(spark, "load_count")


@query(f"SELECT o_orderstatus, count(*) AS n, count(DISTINCT customer_name) AS customers FROM ({_ENRICHED}) GROUP BY o_orderstatus")
def sql_text_step(spark, sf_dir):
    return etl_pipeline(sf_dir).plan(spark, "by_status")


@query("""
    SELECT o_custkey, o_orderkey AS last_order, o_orderpriority AS last_priority, c_name FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) o
    JOIN customer ON o_custkey = c_custkey WHERE k = 1
""")
def lookup_last_duplicate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    columns = {"o_custkey": "o_custkey", "o_orderkey": "last_order", "o_orderpriority": "last_priority"}
    return relational.lookup_join(customers, orders, "c_custkey", "o_custkey", columns, [F.col("o_orderdate"), F.col("o_orderkey")]).drop("c_custkey")


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT max(p_size) FROM part) AS largest")
def context_aggregate(spark, sf_dir):
    made = relational.one_row(
        orders=relational.row_count(table(spark, sf_dir, "orders")),
        users=table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("n")),
        parts=table(spark, sf_dir, "part").agg(F.max("p_size").alias("n")),
    )
    return made.select(F.col("orders.n").alias("orders"), F.col("users.n").alias("users"), F.col("parts.n").alias("largest"))


@query("SELECT l_linenumber, sum(l_quantity * l_quantity) AS total FROM lineitem GROUP BY l_linenumber")
def fanout_reduce(spark, sf_dir):
    return relational.map_reduce(table(spark, sf_dir, "lineitem"), F.col("l_quantity") * F.col("l_quantity"), ["l_linenumber"])


@query("SELECT event_id, value * 2 AS doubled, value + user_id AS added, value * value AS squared FROM events")
def per_item_map(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (value * 2).alias("doubled"), (value + F.col("user_id")).alias("added"), (value * value).alias("squared"))


@query("SELECT sum(CAST(floor(value * 2 * 100) AS BIGINT))::BIGINT AS total FROM events WHERE value * 2 > 50")
def generator_chain(spark, sf_dir):
    numbers = table(spark, sf_dir, "events").select("value")
    doubled = numbers.transform(lambda df: df.select((F.col("value") * 2).alias("x"))).where("x > 50")
    return relational.map_reduce(doubled, F.floor(F.col("x") * 100).cast("long"))


@query("""
    SELECT o_orderkey, 'urgent' AS branch FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'other' FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND NOT o_orderstatus = 'F') AND (o_totalprice > 200000 OR o_orderstatus = 'O')
""")
def branch_condition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & ~(F.col("o_orderstatus") == "F")
    other = ~urgent & ((F.col("o_totalprice") > 200000) | (F.col("o_orderstatus") == "O"))
    pick = lambda condition, name: orders.where(condition).select("o_orderkey", F.lit(name).alias("branch"))
    return pick(urgent, "urgent").unionByName(pick(other, "other"))


# -- pipelines: binding, conditions, retries, events, stored results -------------------------------------------------


def order_steps(sf_dir: str) -> Pipeline:
    """Steps of every kind over ``orders``: made by a template, with static values, soft needs, conditions, retries and a context."""
    tries: list[int] = []

    def by_priority(spark: SparkSession, priority: str) -> DataFrame:
        return table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority)

    make = template(by_priority, tags=("source",))

    def counts(ctx: Context) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).withColumn("step", F.lit(n)) for n, df in sorted(ctx.items())])

    def flaky(urgent: DataFrame) -> DataFrame:
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not there yet")
        return urgent.select("o_orderkey")

    def largest(urgent: DataFrame, never: DataFrame | None, floor: float = 0.0) -> DataFrame:
        return urgent.where(F.col("o_totalprice") > (floor if never is None else -1.0)).groupBy("o_custkey").agg(F.max("o_totalprice").alias("largest"))

    def broken(urgent: DataFrame) -> DataFrame:
        raise ValueError("always")

    def one(urgent: DataFrame) -> DataFrame:
        return relational.row_count(urgent)

    empty = make("none", static={"priority": "no such"})
    same = lambda *names: lambda **given: given[names[0]]
    return Pipeline(
        make("urgent", static={"priority": "1-URGENT"}), make("low", static={"priority": "5-LOW"}), empty,
        Step("counts", counts, needs=("low", "none", "urgent")),
        Step("flaky", flaky, attempts=5, again=lambda e: isinstance(e, OSError)),
        Step("never", same("none"), needs=("none",), when=(non_empty("none"),)),
        Step("behind", lambda never: never), Step("anyway", same("behind"), needs=("behind",), when=(negate(present("behind")),), tolerate_skips=True),
        Step("largest", largest, soft=("never",), static={"floor": 1000.0}),
        Step("broken", broken, attempts=2, continue_on_error=True), Step("after_broken", lambda broken: broken),
        Step("one", one), Step("many", same("one"), needs=("one", "none"), when=(any_of(first_value("one", lambda n: n > 10**9), all_of(first_value("one", bool), negate(non_empty("none")))),)),
        defaults=Defaults(tags=("plain",)),
    )


def priority_steps(spark: SparkSession, sf_dir: str) -> Pipeline:
    """A step for each order priority that the table has. The table also decides which are skipped, how often they are tried and what fails."""
    tried: dict[str, int] = {}
    found = [r[0] for r in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    of = lambda df, item: df.where(F.col("o_orderpriority") == item)

    def part(orders: DataFrame, item: str) -> DataFrame:
        """Isn't there before as many attempts as its number of orders says."""
        tried[item] = tried.get(item, 0) + 1
        if tried[item] <= of(orders, item).count() % 3:
            raise OSError("not there yet")
        return of(orders, item).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"))

    def odd(orders: DataFrame) -> DataFrame:
        if of(orders, found[-1]).count() % 2:
            raise ValueError("an odd number")
        return orders

    def totals(part: DataFrame, odd: DataFrame | None) -> DataFrame:
        return part.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).withColumn("even", F.lit(odd is not None))

    parts = each("part", part, found, attempts=3, again=lambda e: isinstance(e, OSError), tags=("part",), measures={"rows": F.count("*")})
    parts = [s if s.name == "part" else replace(s, when=(lambda inputs, item=s.static["item"]: 5 * of(inputs["orders"], item).count() >= inputs["orders"].count(),)) for s in parts]
    last = in_turn(Step("odd", odd, attempts=2, continue_on_error=True), Step("after_odd", lambda odd: odd), Step("behind", lambda spark: spark.range(1)))
    return Pipeline(Step("orders", lambda spark: table(spark, sf_dir, "orders")), *parts, *last, Step("totals", totals, soft=("odd",)), defaults=Defaults(tags=("plain",)))


_PRIORITIES = """
    p AS (SELECT o_orderpriority AS item, count(*) AS n, 'part_' || (row_number() OVER (ORDER BY o_orderpriority) - 1) AS name FROM orders GROUP BY o_orderpriority),
    l AS (SELECT n % 2 = 1 AS odd FROM p ORDER BY item DESC LIMIT 1),
    s AS (SELECT 'orders' AS name, 'success' AS status, 1 AS attempts UNION ALL SELECT 'part', 'success', 1 UNION ALL SELECT 'totals', 'success', 1
          UNION ALL SELECT name, CASE WHEN 5 * n >= (SELECT count(*) FROM orders) THEN 'success' ELSE 'skipped' END, CASE WHEN 5 * n >= (SELECT count(*) FROM orders) THEN 1 + n % 3 ELSE 0 END FROM p
          UNION ALL SELECT 'odd', CASE WHEN odd THEN 'failed' ELSE 'success' END, CASE WHEN odd THEN 2 ELSE 1 END FROM l
          UNION ALL SELECT unnest(['after_odd', 'behind']), CASE WHEN odd THEN 'skipped' ELSE 'success' END, CASE WHEN odd THEN 0 ELSE 1 END FROM l)
"""


@query(f"WITH {_PRIORITIES} SELECT name, status, attempts::INTEGER AS attempts, CASE WHEN name LIKE 'part\\__%' ESCAPE '\\' THEN 'part' ELSE 'plain' END AS tags FROM s")
def step_statuses(spark, sf_dir):
    report = priority_steps(spark, sf_dir).run(spark)
    return report.runs(spark).select("name", "status", "attempts", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_PRIORITIES} SELECT name, status, count(*) AS n FROM (SELECT name, status FROM s UNION ALL SELECT name, 'running' FROM s WHERE status <> 'skipped') GROUP BY ALL")
def step_events(spark, sf_dir):
    report = priority_steps(spark, sf_dir).run(spark)
    return report.task_events(spark).groupBy("name", "status").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_PRIORITIES} SELECT 'orders' AS src, name AS dst, 'hard' AS kind FROM p UNION ALL SELECT name, 'part', 'hard' FROM p
    UNION ALL SELECT * FROM (VALUES ('orders', 'odd', 'hard'), ('odd', 'after_odd', 'hard'), ('after_odd', 'behind', 'hard'), ('part', 'totals', 'hard'), ('odd', 'totals', 'soft'))
""")
def step_edges(spark, sf_dir):
    return priority_steps(spark, sf_dir).tables(spark)[1].select("src", "dst", "kind")


@query(f"""
    WITH {_PRIORITIES} SELECT name AS step, 'item' AS parameter, item AS source, 'static' AS kind FROM p UNION ALL SELECT name, 'orders', 'orders', 'hard' FROM p UNION ALL SELECT 'part', '(all needs)', name, 'hard' FROM p
    UNION ALL SELECT * FROM (VALUES ('orders', 'spark', 'spark', 'session'), ('odd', 'orders', 'orders', 'hard'), ('after_odd', 'odd', 'odd', 'hard'), ('behind', '(all needs)', 'after_odd', 'hard'), ('behind', 'spark', 'spark', 'session'),
                                     ('totals', 'part', 'part', 'hard'), ('totals', 'odd', 'odd', 'soft'))
""")
def step_bindings(spark, sf_dir):
    return spark.createDataFrame(priority_steps(spark, sf_dir).bindings(), "step string, parameter string, source string, kind string")


@query(f"WITH {_PRIORITIES} SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS kinds, (SELECT NOT odd FROM l) AS even FROM p WHERE 5 * n >= (SELECT count(*) FROM orders)")
def step_fan_out(spark, sf_dir):
    """Parts that are skipped leave the rest to be put together; a soft need that failed is nothing."""
    return priority_steps(spark, sf_dir).run(spark)["totals"]


@query("""
    SELECT 'urgent' AS step, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'low', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'none', 0, NULL
""")
def step_context(spark, sf_dir):
    return order_steps(sf_dir).plan(spark, "counts").select("step", "n", F.round("total", 2).alias("total"))


@query("SELECT o_custkey, max(o_totalprice) AS largest FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000 GROUP BY o_custkey")
def step_soft_default(spark, sf_dir):
    return order_steps(sf_dir).only("largest", "urgent").run(spark)["largest"]


@query("""
    SELECT run, name, status, CASE WHEN run = 3 THEN (SELECT count(*) FROM orders WHERE o_totalprice > 150000) ELSE (SELECT count(*) FROM orders) END AS n, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS kinds
    FROM (VALUES (1, 'orders', 'success'), (1, 'totals', 'success'), (2, 'orders', 'success'), (2, 'totals', 'cached'), (3, 'orders', 'success'), (3, 'totals', 'success')) t(run, name, status)
""")
def stored_steps(spark, sf_dir):
    """A step's stored result is taken up by the next run, although its input is another one by then, until it is cleared."""
    state = TableState(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    totals = Step("totals", lambda orders: orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), store=True, cache_key=lambda inputs: "by-status")
    made = []
    for k in (1, 2, 3):
        if k == 3:
            state.clear()
        least = 150_000 if k > 1 else 0
        report = Pipeline(Step("orders", lambda spark, least=least: table(spark, sf_dir, "orders").where(F.col("o_totalprice") > least)), totals).run(spark, state)
        value = report["totals"].agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        made.append(report.runs(spark).select(F.lit(k).alias("run"), "name", "status").crossJoin(F.broadcast(value)))  # one row
    return reduce(DataFrame.union, made)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment) FROM customer")
def merged_pipelines(spark, sf_dir):
    """Two pipelines with steps of the same names, one within the other under a name of its own."""
    rows = lambda name: Step("rows", lambda spark: table(spark, sf_dir, name))
    first = Pipeline(rows("orders"), Step("large", lambda rows: rows.where("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count("*").alias("n"))))
    second = Pipeline(rows("customer"), Step("large", lambda rows: rows.agg(F.countDistinct("c_mktsegment").alias("n")).select(F.lit("segments").alias("o_orderstatus"), "n")))
    both = first.merged("other", second)
    return both.plan(spark, "large").unionByName(both.plan(spark, "other_large"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS before, 0::BIGINT AS left_over FROM lineitem GROUP BY ALL")
def delete_all(spark, sf_dir):
    path = f"{shared_dir(spark)}/deleted-{uuid.uuid4().hex}"
    by = ["l_returnflag", "l_linestatus"]
    table(spark, sf_dir, "lineitem").select("l_orderkey", *by).write.parquet(path)
    held, _ = counted(spark.read.parquet(path).groupBy(*by).agg(F.count("*").alias("before")), "before")
    files.delete_all(spark, path)
    left = spark.read.parquet(path).groupBy(*by).agg(F.count("l_orderkey").alias("left_over"))
    return held.join(left, by, "left").na.fill(0, ["left_over"])


@query("SELECT replace(p_name, ' ', '-') AS name, p_size || '.' || p_partkey AS version FROM part WHERE p_partkey % 2 = 0")
def requirement_files(spark, sf_dir):
    """Lines written as text files and read again; comments and other lines are left out."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    name, version = F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(name, F.lit("=="), version)).otherwise(F.concat(F.lit("# "), name))
    files.write_lines(table(spark, sf_dir, "part").select(line.alias("line")), "line", path)
    return files.read_requirements(spark, path)


# -- search, paging, grouping ----------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE text ILIKE '%EN%la%' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def search_field(spark, sf_dir):
    found = relational.search(table(spark, sf_dir, "documents"), "EN%la", ["text"])
    return relational.page(found.select("doc_id", "lang", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 5)


@query("SELECT doc_id, lang, source FROM documents WHERE lang ILIKE '%F_%' OR source ILIKE '%F_%' OR text ILIKE '%F_%' ORDER BY doc_id LIMIT 50 OFFSET 10")
def search_all(spark, sf_dir):
    found = relational.search(table(spark, sf_dir, "documents"), "F_", ["lang", "source", "text"])
    return relational.page(found.select("doc_id", "lang", "source"), [F.col("doc_id")], 50, 10)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 50")
def page_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return relational.page(orders, [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 50).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def lookup_by_id(spark, sf_dir):
    return relational.lookup_by_id(table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_totalprice")


_SUBJECTS = """
    SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN 'Re: ' || p_name WHEN 1 THEN 'FWD:  ' || p_name || ' ' WHEN 2 THEN 'Re: fw: ' || p_name WHEN 3 THEN '  ' ELSE p_name END AS subject
    FROM part
"""
_THREADS = f"""
    SELECT p_partkey, p_size, CASE WHEN s = '' THEN '{relational.NO_SUBJECT}' ELSE s END AS subject
    FROM (SELECT *, regexp_replace(regexp_replace(subject, '^(re|fwd|fw):\\s*', '', 'i'), '^\\s+|\\s+$', '', 'g') AS s FROM ({_SUBJECTS}))
"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_partkey") % 5
    subject = (
        F.when(kind == 0, F.concat(F.lit("Re: "), name)).when(kind == 1, F.concat(F.lit("FWD:  "), name, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("Re: fw: "), name)).when(kind == 3, F.lit("  ")).otherwise(name)
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", subject.alias("subject"))


@query(f"SELECT subject, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key, max(p_size) AS latest FROM ({_THREADS}) GROUP BY subject")
def group_threads(spark, sf_dir):
    return relational.group_threads(_subjects(spark, sf_dir), "subject", "p_partkey", "p_size")


@query(f"""
    SELECT subject AS thread, p_partkey, place FROM (
      SELECT *, row_number() OVER (PARTITION BY subject ORDER BY p_size DESC, p_partkey)::INTEGER AS place FROM ({_THREADS})) WHERE place <= 3
""")
def thread_members(spark, sf_dir):
    return relational.threads_with_members(_subjects(spark, sf_dir), "subject", "p_size", "p_partkey", 3).select("thread", "p_partkey", "place")


@query(f"SELECT subject AS thread, p_partkey, row_number() OVER (PARTITION BY subject ORDER BY p_size, p_partkey) AS place FROM ({_THREADS})")
def whole_threads(spark, sf_dir):
    return relational.whole_threads(_subjects(spark, sf_dir), "subject", "p_size", "p_partkey", rows=PART).select("thread", "p_partkey", "place")


_NEEDLES = ["%licen_e%", "XY_z%qq", "Ab", "example.org"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS keyword, doc_id, lang FROM documents WHERE text ILIKE '%{n}%' AND (doc_id % 9 <> 4 OR doc_id % 27 = 4)" for n in _NEEDLES))
def indexed_search(spark, sf_dir):
    """Documents stored in two turns, some of them deleted, and some of those added again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "doc_id", "text")
    index.add(docs.where("doc_id % 2 = 0"), blocks=16)
    index.add(docs.where("doc_id % 2 = 1"), blocks=16)
    index.delete(docs.where("doc_id % 9 = 4").select("doc_id"))
    index.add(docs.where("doc_id % 27 = 4"), blocks=4)
    return reduce(DataFrame.union, [index.search(n).select(F.lit(n).alias("keyword"), "doc_id", "lang") for n in _NEEDLES])


# -- archive: upsert, import, retention, names -----------------------------------------------------------------------


@query("""
    SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1
""")
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return relational.upsert_latest(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("""
    SELECT 1 AS version, user_id, event_type, max(event_id) AS event_id, count(*) OVER () AS n FROM events WHERE event_id % 2 = 0 GROUP BY user_id, event_type
    UNION ALL SELECT 3, user_id, event_type, max(event_id), count(*) OVER () FROM events WHERE user_id % 50 <> 7 AND (event_id % 2 = 0 OR user_id % 100 < 10) GROUP BY user_id, event_type
""")
def table_versions(spark, sf_dir):
    """A table as it was first, and after an upsert of some users and the deletion of others."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    held = VersionedTable(spark, f"{shared_dir(spark)}/versioned-{uuid.uuid4().hex}", ["user_id", "event_type"], 32)
    held.upsert(events.where("event_id % 2 = 0"), "event_id")
    held.upsert(events.where("user_id % 100 < 10"), "event_id")
    held.delete(events.where("user_id % 50 = 7"))
    of = lambda version: held.read(version).select(F.lit(version).alias("version"), "user_id", "event_type", "event_id", F.lit(held.read(version).count()).alias("n"))
    return of(1).union(of(3))


_CHANGES = """
    SELECT i.o_orderkey, i.h AS file_hash, CASE WHEN s.k IS NULL THEN 'new' WHEN s.h <> i.h THEN 'updated' ELSE 'unchanged' END AS change
    FROM (SELECT o_orderkey, md5(o_orderstatus || o_orderpriority) AS h FROM orders) i
    LEFT JOIN (SELECT o_orderkey AS k, md5(o_orderstatus || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END) AS h FROM orders WHERE o_orderkey % 7 <> 0) s
      ON s.k = i.o_orderkey
"""


def _import_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    hashed = lambda extra: F.md5(F.concat("o_orderstatus", "o_orderpriority", extra)).alias("file_hash")
    changed = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("")
    return orders.select("o_orderkey", hashed(F.lit(""))), orders.where("o_orderkey % 7 <> 0").select("o_orderkey", hashed(changed))


@query(_CHANGES)
def classify_import(spark, sf_dir):
    return relational.classify_import(*_import_sides(spark, sf_dir), "o_orderkey", "file_hash")


@query(f"SELECT * FROM ({_CHANGES}) WHERE change <> 'unchanged'")
def import_delta(spark, sf_dir):
    return relational.import_delta(*_import_sides(spark, sf_dir), "o_orderkey", "file_hash")


@query("""
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k > 5
""")
def retain_newest(spark, sf_dir):
    return relational.beyond_newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("""
    SELECT DISTINCT '*WID?et' AS glob, p_name AS name FROM part WHERE lower(p_name) LIKE '%wid_et'
    UNION ALL SELECT DISTINCT '[!r-z]* r?ng', p_name FROM part WHERE regexp_full_match(lower(p_name), '[^r-z].* r.ng')
    UNION ALL SELECT 'no such part', 'no such part'
""")
def glob_match(spark, sf_dir):
    return relational.glob_match(table(spark, sf_dir, "part"), "p_name", ["*WID?et", "[!r-z]* r?ng", "no such part"])


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('Machinery'), ('FURNITURE')) p(name) WHERE lower(p.name) = lower(c.c_mktsegment))")
def protected_exclude(spark, sf_dir):
    protected = spark.createDataFrame([("Machinery",), ("FURNITURE",)], "name string")
    return relational.exclude_protected(table(spark, sf_dir, "customer"), "c_mktsegment", protected, "name").select("c_custkey", "c_mktsegment")


@query("SELECT user_id, arg_min(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id")
def first_non_null(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return relational.first_non_null(events, ["user_id"], "value", "event_id")


@query("SELECT place::INTEGER AS place, p_partkey, p_name FROM (VALUES (0, 3), (1, 1), (2, 999999999), (3, 3), (4, 20)) o(place, wanted) JOIN part ON p_partkey = wanted")
def reorder_items(spark, sf_dir):
    return relational.reorder(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", [3, 1, 999999999, 3, 20])


_PATHS = "SELECT p_partkey, '/src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '.PYC' ELSE '.py' END AS path FROM part"


@query(f"SELECT * FROM ({_PATHS}) WHERE NOT contains(path, '/economy/') AND NOT ends_with(lower(path), '.pyc') AND NOT contains(path, 'red_')")
def directory_filters(spark, sf_dir):
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".PYC").otherwise(".py")
    path = F.concat(F.lit("/src/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), suffix)
    listed = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return relational.without_ignored(listed, "path", directories=["economy"], suffixes=[".pyc"], substrings=["red_"])


_PLAIN = "coalesce(text, '')"
_MAIL = f"""
    SELECT doc_id, 'From: ' || source || '@example.org' || chr(10) || 'To: all@example.org' || chr(10)
           || 'Subject: ' || CASE doc_id % 4 WHEN 0 THEN 'Re: ' || lang WHEN 1 THEN '=?utf-8?B?' || to_base64(encode('Re: ' || lang || ' «ü» 中')) || '?=' WHEN 2 THEN 'Fwd: =?iso-8859-1?Q?' || lang || '_gr=FC=DFt?=' ELSE '=?utf-8?q?a_?= =?utf-8?q?b?= ' || lang END || chr(10)
           || 'Date: ' || CASE doc_id % 3 WHEN 0 THEN 'Mon, 1 Jan 2024 12:00:00 +0000' WHEN 1 THEN (doc_id % 28 + 1) || ' Feb 2023 0' || doc_id % 10 || ':30:15 +0130' ELSE 'Invalid Date' END || chr(10)
           || CASE WHEN doc_id % 5 < 2 THEN 'MIME-Version: 1.0' || chr(10) || 'Content-Type: multipart/mixed; boundary="=cut="' || chr(10) || chr(10) || '--=cut=' || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(10) || chr(10) || '<b>' || lang || '</b>' || chr(10)
                   || CASE WHEN doc_id % 5 = 0 THEN '--=cut=' || chr(10) || 'Content-Type: text/plain' || chr(10) || 'Content-Disposition: attachment; filename="a.txt"' || chr(10) || chr(10) || 'attached' || chr(10) ELSE '' END
                   || '--=cut=' || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || to_base64(encode({_PLAIN})) || chr(10) || '--=cut=--' || chr(10)
              ELSE chr(10) || {_PLAIN} END AS mail,
           CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || ' «ü» 中' WHEN 2 THEN lang || ' grüßt' ELSE 'a b ' || lang END AS thread,
           CASE doc_id % 3 WHEN 0 THEN '2024-01-01T12:00:00+00:00' WHEN 1 THEN '2023-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T0' || doc_id % 10 || ':30:15+01:30' ELSE 'Invalid Date' END AS date_parsed,
           CASE WHEN doc_id % 5 < 2 THEN '<b>' || lang || '</b>' ELSE '' END AS body_html, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS has_attachments, source, text
    FROM documents
"""


@query(f"""
    SELECT doc_id, md5(mail) AS file_hash, source || '@example.org' AS sender, 'all@example.org' AS recipients, thread, date_parsed, substr({_PLAIN}, 1, 5000) AS body_text, body_html, has_attachments FROM ({_MAIL})
""")
def mail_parse(spark, sf_dir):
    """Mails of all kinds made of documents: encoded subjects, dates with zones, multipart bodies and attachments."""
    key, lang, nl = F.col("doc_id"), F.col("lang"), F.lit("\n")
    body = F.coalesce("text", F.lit(""))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    coded = lambda c: F.base64(F.encode(c, "UTF-8"))
    subject = (
        F.when(key % 4 == 0, text("Re: ", lang)).when(key % 4 == 1, text("=?utf-8?B?", coded(text("Re: ", lang, " «ü» 中")), "?=")).when(key % 4 == 2, text("Fwd: =?iso-8859-1?Q?", lang, "_gr=FC=DFt?="))
        .otherwise(text("=?utf-8?q?a_?= =?utf-8?q?b?= ", lang))
    )
    day = F.when(key % 3 == 0, "Mon, 1 Jan 2024 12:00:00 +0000").when(key % 3 == 1, text((key % 28 + 1).cast("string"), " Feb 2023 0", (key % 10).cast("string"), ":30:15 +0130")).otherwise("Invalid Date")
    attached = F.when(key % 5 == 0, '--=cut=\nContent-Type: text/plain\nContent-Disposition: attachment; filename="a.txt"\n\nattached\n').otherwise("")
    parts = text(
        'MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=cut="\n\n--=cut=\nContent-Type: text/html; charset=utf-8\n\n<b>', lang, "</b>\n", attached,
        "--=cut=\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n", F.regexp_replace(coded(body), "\\s", ""), "\n--=cut=--\n",
    )
    mail = text("From: ", F.col("source"), "@example.org\nTo: all@example.org\nSubject: ", subject, "\nDate: ", day, nl, F.when(key % 5 < 2, parts).otherwise(F.concat(nl, body)))
    mails = table(spark, sf_dir, "documents").select(key.cast("string").alias("file_path"), mail.cast("binary").alias("content"), F.length(mail).cast("long").alias("file_size"))
    thread = X.normalize_subject(F.col("subject")).alias("thread")
    return parse_mails(mails).select(F.col("file_path").cast("long").alias("doc_id"), "file_hash", "sender", "recipients", thread, "date_parsed", "body_text", "body_html", "has_attachments")


# -- text functions --------------------------------------------------------------------------------------------------


@query("""
    SELECT p_partkey, regexp_replace(name, '(?:19|20)[0-9]{2}[-_#.~]?(?:0[1-9]|1[0-2])[-_#.~]?(?:0[1-9]|[12][0-9]|3[01])[-_#.~]?', '', 'g') AS bare
    FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '20240131_' || p_name WHEN 1 THEN p_name || '-2023.05.06~1999-12-31' ELSE p_name || '20241399' END AS name FROM part)
""")
def strip_date_prefix(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_partkey") % 3
    dated = F.when(kind == 0, F.concat(F.lit("20240131_"), name)).when(kind == 1, F.concat(name, F.lit("-2023.05.06~1999-12-31"))).otherwise(F.concat(name, F.lit("20241399")))
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_date_prefix(dated).alias("bare"))


@query("""
    SELECT o_orderkey, strftime(greatest(o_orderdate, o_orderdate + INTERVAL 40 DAY), '%Y%m%d') || '_' || o_orderpriority AS name FROM orders
""")
def add_date_prefix(spark, sf_dir):
    later = F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.add_date_prefix(F.concat(F.lit("2020-01-02_"), "o_orderpriority"), F.col("o_orderdate"), later).alias("name"))


def _strip_marks_sql(column: str) -> str:
    left, right = (f"[{re.escape(x)}]" for x in (X.LEFT_MARKS, X.RIGHT_MARKS))
    for mark in [*(m for names in X.LEVELS.values() for m in names.split(",") if m), *map(str, range(1, 10))]:
        column = f"regexp_replace({column}, '{left}{mark}{right}', '', 'g')"
    return column


@query(f"""
    SELECT p_partkey, {_strip_marks_sql('name')} || '(CON)' AS leveled
    FROM (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '(PUB)' WHEN 1 THEN '[INT](NOR)' WHEN 2 THEN '_3_7_' WHEN 3 THEN '_(3)3_b' ELSE '【CLA】PUB' END AS name FROM part)
""")
def set_level(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(kind == 0, "(PUB)").when(kind == 1, "[INT](NOR)").when(kind == 2, "_3_7_").when(kind == 3, "_(3)3_b").otherwise("【CLA】PUB"))
    return table(spark, sf_dir, "part").select("p_partkey", X.set_level(name, 3).alias("leveled"))


_VERSIONS = """SELECT p_partkey, CASE p_partkey % 12 WHEN 5 THEN '1.02.x' WHEN 7 THEN '1.2.3-01' WHEN 8 THEN '1.2.3-a..b' WHEN 9 THEN '1234567890123456789999.99.9' WHEN 10 THEN '1.2.3-0a.-+01.b-c' WHEN 11 THEN '1.2'
                      ELSE CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END || p_size || '.' || p_partkey % 10 || '.' || p_partkey % 100
                      || CASE p_partkey % 3 WHEN 0 THEN '-rc.1' WHEN 1 THEN '+build5' ELSE '' END END AS version FROM part"""
#: The parts of a version by cutting at its signs; ``ok`` by looking at each part.
_PARSED = f"""
    SELECT *, len(core) = 3 AND list_bool_and(list_transform(core, lambda x: x <> '' AND translate(x, '0123456789', '') = '' AND (x = '0' OR x[1] <> '0')))
           AND (NOT has_pre OR list_bool_and(list_transform(string_split(pre, '.'), lambda x: x <> '' AND (translate(x, '0123456789', '') <> '' OR x = '0' OR x[1] <> '0'))))
           AND (build IS NULL OR list_bool_and(list_transform(string_split(build, '.'), lambda x: x <> ''))) AS ok
    FROM (SELECT p_partkey, string_split(string_split(main, '-')[1], '.') AS core, contains(main, '-') AS has_pre, CASE WHEN contains(main, '-') THEN substr(main, instr(main, '-') + 1) ELSE '' END AS pre, build
          FROM (SELECT p_partkey, string_split(ltrim(version, 'v'), '+')[1] AS main, string_split(version, '+')[2] AS build FROM ({_VERSIONS})))
"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    numbers = F.concat_ws(".", F.col("p_size").cast("string"), (key % 10).cast("string"), (key % 100).cast("string"))
    full = F.concat(F.when(key % 2 == 0, "v").otherwise(""), numbers, F.when(key % 3 == 0, "-rc.1").when(key % 3 == 1, "+build5").otherwise(""))
    odd = {5: "1.02.x", 7: "1.2.3-01", 8: "1.2.3-a..b", 9: "1234567890123456789999.99.9", 10: "1.2.3-0a.-+01.b-c", 11: "1.2"}
    for k, version in odd.items():
        full = F.when(key % 12 == k, version).otherwise(full)
    return table(spark, sf_dir, "part").select("p_partkey", full.alias("version"))


@query(f"""
    SELECT p_partkey, CASE WHEN ok THEN core[1] || '.' || core[2] || '.' || (core[3]::HUGEINT + 1) END AS patch, CASE WHEN ok THEN core[1] || '.' || (core[2]::HUGEINT + 1) || '.0' END AS minor,
           CASE WHEN ok THEN (core[1]::HUGEINT + 1) || '.0.0' END AS major
    FROM ({_PARSED})
""")
def bump_version(spark, sf_dir):
    return _versions(spark, sf_dir).select("p_partkey", *[X.bump_version(F.col("version"), p).alias(p) for p in ("patch", "minor", "major")])


@query(f"SELECT p_partkey, pre, coalesce(build, '') AS build, core[1] AS major FROM ({_PARSED}) WHERE ok")
def parse_version(spark, sf_dir):
    parsed = _versions(spark, sf_dir).select("p_partkey", X.parse_version(F.col("version")).alias("v")).where("v IS NOT NULL")
    return parsed.select("p_partkey", "v.pre", "v.build", F.col("v.major").cast("string").alias("major"))


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'version = "' || p_size || '.5.0"  # ' || p_name WHEN 1 THEN '__version__=''' || p_size || '.5.0''' ELSE 'name = "4.4.4"' END AS line FROM part
""")
def bump_assignment(spark, sf_dir):
    kind, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    line = F.when(kind == 0, F.concat(F.lit('version = "'), size, F.lit('.4.9-rc1"  # '), "p_name")).when(kind == 1, F.concat(F.lit("__version__='"), size, F.lit(".4.0'"))).otherwise(F.lit('name = "4.4.4"'))
    return table(spark, sf_dir, "part").select("p_partkey", X.bump_assignment(line, "minor").alias("line"))


@query("""
    SELECT p_partkey, CASE WHEN contains(stem, 'cli') THEN 'Command-line interface for ' || p_type || '.' WHEN contains(stem, 'test') THEN 'Tests for ' || p_type || '.'
           ELSE array_to_string(list_transform(string_split(regexp_replace(replace(stem, '_', ' '), '([^A-Za-z])', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda w: upper(w[1]) || lower(w[2:])), '') || ' module.' END AS doc
    FROM (SELECT p_partkey, p_type, replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '_cli' WHEN 1 THEN '_test_cli' WHEN 2 THEN '_test' WHEN 3 THEN '_it''s_4ever_MAD' ELSE '' END AS stem FROM part)
""")
def classify_stem(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    mark = F.when(kind == 0, "_cli").when(kind == 1, "_test_cli").when(kind == 2, "_test").when(kind == 3, "_it's_4ever_MAD").otherwise("")
    name = F.concat(F.lit("/a.b/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), mark, F.lit(".py"))
    return table(spark, sf_dir, "part").select("p_partkey", X.classify_stem(X.stem(name), F.col("p_type")).alias("doc"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN (1.0::DOUBLE - (p_partkey % 5)::DOUBLE / (p_size % 7)::DOUBLE) * 100 END AS saved FROM part")
def compression_ratio(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.compression_ratio(F.col("p_size") % 7, F.col("p_partkey") % 5).alias("saved"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS name, p_size || '.0' AS version FROM part WHERE p_partkey % 2 = 0")
def requirement_lines(spark, sf_dir):
    separator = F.when(F.col("p_partkey") % 2 == 0, "== ").otherwise(">=")
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), separator, F.col("p_size").cast("string"), F.lit(".0")).alias("line"))
    return lines.select("p_partkey", X.requirement_name(F.col("line")).alias("name"), X.requirement_version(F.col("line")).alias("version")).where("name IS NOT NULL")


# -- task graphs: a graph for each conversation, a node for each turn ------------------------------------------------


def turn_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turn k needs turn k - 1 (softly, if k is a multiple of 3) and turn k - 2."""
    turns = table(spark, sf_dir, "conversations")
    weight = (F.length("text") * 1024 + F.pow(F.lit(2.0), F.col("turn"))) / 1024.0
    nodes = turns.select(F.col("conv_id").alias("graph"), F.col("turn").cast("string").alias("name"), "turn", "role", F.length("text").alias("chars"), weight.alias("weight"))
    need = lambda back, kind, pos: F.struct((F.col("turn") - back).alias("src"), kind.alias("kind"), F.lit(pos).alias("pos"))
    needs = F.array(need(1, F.when(F.col("turn") % 3 == 0, "soft").otherwise("hard"), 0), need(2, F.lit("hard"), 1))
    edges = nodes.select("graph", F.explode(needs).alias("e"), F.col("name").alias("dst"))
    edges = edges.select("graph", F.col("e.src").cast("string").alias("src"), "dst", "e.kind", "e.pos")
    return nodes, graphs.prune_edges(nodes, edges)


_TURNS = "n AS (SELECT conv_id AS graph, turn AS node, role, length(text) AS chars, (length(text) * 1024 + power(2.0, turn)) / 1024.0 AS weight FROM conversations)"
_TURN_EDGES = _TURNS + """,
    a AS (SELECT b.graph, a.node AS src, b.node AS dst, CASE WHEN a.node = b.node - 1 AND b.node % 3 = 0 THEN 'soft' ELSE 'hard' END AS kind
          FROM n a JOIN n b ON a.graph = b.graph AND (a.node = b.node - 1 OR a.node = b.node - 2)),
    e AS (SELECT graph, src, dst FROM a WHERE kind = 'hard')"""
_TURN_PATHS = _TURN_EDGES + """, p AS (
      SELECT graph, node, 0 AS depth, weight AS total, [node] AS path FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND e.dst = n.node)
      UNION SELECT p.graph, e.dst, depth + 1, total + weight, list_append(path, e.dst) FROM p JOIN e ON e.graph = p.graph AND e.src = p.node JOIN n ON n.graph = e.graph AND n.node = e.dst)"""


@query(f"WITH RECURSIVE {_TURN_PATHS} SELECT graph, node::VARCHAR AS name, max(depth)::INTEGER AS layer FROM p GROUP BY graph, node")
def layers(spark, sf_dir):
    return graphs.layers(*turn_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {_TURN_PATHS} SELECT graph, node::VARCHAR AS name, max(total) AS total FROM p GROUP BY graph, node")
def longest_paths(spark, sf_dir):
    return graphs.longest_paths(*turn_graph(spark, sf_dir), "weight").select("graph", "name", "total")


@query(f"WITH RECURSIVE {_TURN_PATHS} SELECT graph, max(total) AS total, array_to_string(arg_max(path, total), '>') AS path FROM p GROUP BY graph")
def critical_path(spark, sf_dir):
    return graphs.critical_path(*turn_graph(spark, sf_dir), "weight").select("graph", "total", F.array_join("path", ">").alias("path"))


@query(f"WITH {_TURN_EDGES} SELECT graph, src::VARCHAR AS src, dst::VARCHAR AS dst, kind FROM a WHERE (SELECT role = 'user' OR chars > 500 FROM n WHERE n.graph = a.graph AND n.node = a.src) AND (SELECT role = 'user' OR chars > 500 FROM n WHERE n.graph = a.graph AND n.node = a.dst)")
def tag_subgraph(spark, sf_dir):
    nodes, edges = turn_graph(spark, sf_dir)
    tagged = nodes.withColumn("tags", F.array_compact(F.array("role", F.when(F.col("chars") > 500, "long"))))
    return graphs.subgraph_by_tags(tagged, edges, ["user", "long"])[1].select("graph", "src", "dst", "kind")


@query(f"WITH {_TURN_EDGES} SELECT graph, src::VARCHAR AS src, dst::VARCHAR AS dst, kind FROM a WHERE src < 3 AND dst < 3")
def names_subgraph(spark, sf_dir):
    nodes, edges = turn_graph(spark, sf_dir)
    return graphs.subgraph_by_names(nodes, edges, nodes.where("turn < 3"))[1].select("graph", "src", "dst", "kind")


@query(f"WITH RECURSIVE {_TURN_EDGES}, r AS (SELECT graph, node FROM n WHERE node = 1 UNION SELECT r.graph, a.dst FROM r JOIN a ON a.graph = r.graph AND a.src = r.node) SELECT graph, node::VARCHAR AS name FROM r")
def downstream(spark, sf_dir):
    nodes, edges = turn_graph(spark, sf_dir)
    return graphs.downstream(nodes.where("turn = 1"), edges)


@query("SELECT conv_id AS graph, lag(turn) OVER w AS src, turn AS dst FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY src IS NOT NULL")
def chain_edges(spark, sf_dir):
    nodes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("name"))
    return graphs.chain_edges(nodes, "name").select("graph", "src", "dst")


@query("SELECT conv_id AS graph, 'work' || '[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS name, turn AS item FROM conversations")
def fan_out(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("item"))
    nodes = items.select("graph").distinct().withColumn("name", F.lit("work"))
    return graphs.fan_out(nodes, items).select("graph", "name", "item")


@query(f"WITH {_TURN_EDGES}, k AS (SELECT * FROM n WHERE node % 4 <> 2) SELECT graph, src::VARCHAR AS src, dst::VARCHAR AS dst, kind, (CASE WHEN dst % 4 = 2 THEN dst ELSE src END)::VARCHAR AS missing FROM a WHERE src % 4 = 2 OR dst % 4 = 2")
def missing_inputs(spark, sf_dir):
    nodes, edges = turn_graph(spark, sf_dir)
    return graphs.missing_inputs(nodes.where("turn % 4 <> 2"), edges).select("graph", "src", "dst", "kind", "missing")


@query(f"WITH {_TURN_EDGES} SELECT 'ns:' || node AS name, n.graph, count(a.src) AS needs FROM n LEFT JOIN a ON a.graph = n.graph AND a.dst = n.node GROUP BY n.graph, node")
def namespaces(spark, sf_dir):
    nodes, edges = graphs.with_namespace(*turn_graph(spark, sf_dir), "ns")
    needs = edges.groupBy("graph", F.col("dst").alias("name")).agg(F.count("*").alias("needs"))
    return nodes.select("graph", "name").join(needs, ["graph", "name"], "left").na.fill(0, ["needs"])


@query(f"""
    WITH {_TURN_EDGES},
    l AS (SELECT graph, 0 AS part, '    ' || node AS line FROM n UNION ALL SELECT graph, 1, '    ' || src || CASE kind WHEN 'soft' THEN ' -.-> ' ELSE ' --> ' END || dst FROM a)
    SELECT graph, 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, line) AS diagram FROM l GROUP BY graph
""")
def mermaid(spark, sf_dir):
    return graphs.mermaid(*turn_graph(spark, sf_dir), "LR")


@query(f"""
    WITH RECURSIVE {_TURN_PATHS}, d AS (SELECT graph, max(depth) + 1 AS n_layers FROM p GROUP BY graph)
    SELECT graph, (SELECT count(*) FROM n WHERE n.graph = d.graph) AS n_nodes, (SELECT count(*) FROM e WHERE e.graph = d.graph) AS n_hard, (SELECT count(*) FROM a WHERE a.graph = d.graph AND kind = 'soft') AS n_soft, n_layers::INTEGER AS n_layers FROM d
""")
def describe_graph(spark, sf_dir):
    return graphs.describe(*turn_graph(spark, sf_dir))


@query(f"""
    WITH {_TURN_EDGES}, m AS (SELECT DISTINCT graph AS ref, graph // 2 AS m FROM n),
    last1 AS (SELECT m.m, m.ref, m.ref || ':' || max(node) AS name FROM m JOIN n ON n.graph = m.ref GROUP BY m.m, m.ref),
    free1 AS (SELECT m.m, m.ref, m.ref || ':' || node AS name FROM m JOIN n ON n.graph = m.ref WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND e.dst = n.node)),
    x AS (SELECT m, m.ref || ':' || src AS src, m.ref || ':' || dst AS dst, kind FROM m JOIN a ON a.graph = m.ref
          UNION ALL SELECT f.m, l.name, f.name, 'hard' FROM free1 f JOIN last1 l ON l.m = f.m AND l.ref < f.ref),
    last2 AS (SELECT m, arg_max(name, ref) AS name FROM last1 GROUP BY m)
    SELECT 'm' || m AS graph, src, dst, kind FROM x
    UNION ALL SELECT 't' || m // 2, src, dst, kind FROM x
    UNION ALL SELECT 't' || f.m // 2, l.name, f.name, 'hard' FROM free1 f JOIN last2 l ON l.m = f.m - 1 AND l.m // 2 = f.m // 2 WHERE f.ref = (SELECT min(ref) FROM last1 WHERE last1.m = f.m)
    UNION ALL SELECT 'k' || a.graph, a.graph || ':' || src, a.graph || ':' || dst, kind FROM a WHERE dst = (SELECT max(node) FROM n WHERE n.graph = a.graph)
""")
def expand_references(spark, sf_dir):
    """Graphs m of two conversations, t of two graphs m, and k of a conversation's last turn (a reference to one task)."""
    nodes, edges = turn_graph(spark, sf_dir)
    key = lambda kind, column: F.concat(F.lit(kind), column.cast("string"))
    named = lambda c: F.concat(F.col("graph").cast("string"), F.lit(":"), F.col(c)).alias(c)
    own = key("g", F.col("graph")).alias("graph")
    unique = nodes.select(own, named("name"), F.col("turn").alias("pos"))
    every = nodes.groupBy("graph").agg(F.max("turn").alias("last"))
    half = F.expr("graph div 2")
    twos = every.select(key("m", half).alias("graph"), (F.col("graph") % 2).alias("pos"), key("g", F.col("graph")).alias("ref"))
    fours = every.select(key("t", F.expr("graph div 4")).alias("graph"), (half % 2).alias("pos"), key("m", half).alias("ref")).distinct()
    ends = every.select(key("k", F.col("graph")).alias("graph"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("g"), F.col("graph").cast("string"), F.lit("."), F.col("graph").cast("string"), F.lit(":"), F.col("last").cast("string")).alias("ref"))
    members = twos.union(fours).union(ends)
    return graphs.expand_references(members, unique, edges.select(own, named("src"), named("dst"), "kind", "pos"))[1].select("graph", "src", "dst", "kind")


@query(f"WITH RECURSIVE {_TURNS}, r AS (SELECT graph, CASE WHEN graph % 10 = 0 AND role = 'user' THEN graph ELSE graph // 2 END AS ref FROM n WHERE graph >= 8), k AS (SELECT DISTINCT graph, ref FROM r), bad AS (SELECT graph FROM k WHERE graph = ref UNION SELECT k.graph FROM k JOIN bad ON k.ref = bad.graph) SELECT DISTINCT 'g' || graph AS graph FROM bad WHERE graph IN (SELECT graph FROM k)")
def cyclic_references(spark, sf_dir):
    """Graphs that refer to themselves, or to one that does, however far away."""
    nodes, _ = turn_graph(spark, sf_dir)
    ref = F.when((F.col("graph") % 10 == 0) & (F.col("role") == "user"), F.col("graph")).otherwise(F.expr("graph div 2"))
    members = nodes.where("graph >= 8").select(F.concat(F.lit("g"), F.col("graph").cast("string")).alias("graph"), F.concat(F.lit("g"), ref.cast("string")).alias("ref"))
    return graphs.reference_levels(members).where("level IS NULL").select("graph")


# -- how tasks run, as tables ----------------------------------------------------------------------------------------


@query(f"""
    WITH RECURSIVE {_TURN_EDGES}, bad AS (
      SELECT graph, node FROM n WHERE node = 1 AND graph % 3 = 0
      UNION SELECT e.graph, e.dst FROM bad JOIN e ON e.graph = bad.graph AND e.src = bad.node WHERE e.dst % 5 <> 4)
    SELECT n.graph, n.node::VARCHAR AS name, CASE WHEN n.node = 1 AND n.graph % 3 = 0 THEN 'failed' WHEN bad.node IS NOT NULL THEN 'skipped' WHEN n.node % 2 = 0 THEN 'cached' ELSE 'success' END AS status
    FROM n LEFT JOIN bad ON bad.graph = n.graph AND bad.node = n.node
""")
def skip_propagation(spark, sf_dir):
    nodes, edges = turn_graph(spark, sf_dir)
    status = F.when((F.col("turn") == 1) & (F.col("graph") % 3 == 0), "failed").when(F.col("turn") % 2 == 0, "cached").otherwise("success")
    statuses = nodes.select("graph", "name", status.alias("status"), (F.col("turn") % 5 == 4).alias("tolerant"))
    return dispatch.skip_propagation(statuses, edges).select("graph", "name", "status")


@query("SELECT conv_id AS graph, turn::VARCHAR AS name, turn // 2 AS layer, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY length(text) % 3 DESC, turn::VARCHAR)::INTEGER AS place FROM conversations")
def dispatch_order(spark, sf_dir):
    nodes = turn_graph(spark, sf_dir)[0].select("graph", "name", F.expr("turn div 2").alias("layer"), (F.col("chars") % 3).alias("priority"))
    return dispatch.dispatch_order(nodes).select("graph", "name", "layer", "place")


@query("""
    SELECT conv_id AS graph, turn::VARCHAR AS name,
           ((row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) % 3 DESC, turn::VARCHAR) - 1) // CASE role WHEN 'user' THEN 2 ELSE 1 END)::INTEGER AS wave
    FROM conversations
""")
def limit_waves(spark, sf_dir):
    nodes = turn_graph(spark, sf_dir)[0].select("graph", "name", F.col("role").alias("concurrency_key"), (F.col("chars") % 3).alias("priority"))
    limits = spark.createDataFrame([("user", 2)], "concurrency_key string, allowed int")
    return dispatch.waves(nodes, limits, ["graph"]).select("graph", "name", "wave")


@query("""
    SELECT p_partkey, attempt::INTEGER AS attempt, wait, sum(wait) OVER (PARTITION BY p_partkey ORDER BY attempt) AS starts_after
    FROM (SELECT p_partkey, attempt, CASE WHEN attempt > 1 THEN 0.5::DOUBLE * power(2.0::DOUBLE, attempt - 2) ELSE 0.0::DOUBLE END AS wait
          FROM part, unnest(generate_series(1, p_size % 4 + 1)) t(attempt))
""")
def retry_schedule(spark, sf_dir):
    policies = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("max_attempts"), F.lit(0.5).alias("delay"), F.lit(2.0).alias("backoff"))
    return dispatch.retry_schedule(policies).select("p_partkey", "attempt", "wait", "starts_after")


@query("""
    WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt, value > 100 AS ok, value < 60 AS retryable FROM events),
    b AS (SELECT *, coalesce(max((ok OR NOT retryable)::INTEGER) OVER (PARTITION BY user_id, event_type ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM a)
    SELECT user_id AS graph, event_type AS name, max(attempt)::INTEGER AS attempts, CASE WHEN bool_or(ok) THEN 'success' ELSE 'failed' END AS status FROM b WHERE ended = 0 AND attempt <= 8 GROUP BY user_id, event_type
""")
def settle_attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("graph"), F.col("event_type").alias("name"), "event_id", "value")
    numbered = events.selectExpr("graph", "name", "row_number() OVER (PARTITION BY graph, name ORDER BY event_id) AS attempt", "value > 100 AS ok", "value < 60 AS retryable", "8 AS max_attempts")
    return dispatch.settle_attempts(numbered)


@query("""
    SELECT user_id % 10 AS graph, user_id::VARCHAR AS name, count(*) AS n_unmet, array_to_string(list_sort(list_distinct(list(event_type)))[1:2], ', ') AS reason
    FROM events WHERE NOT coalesce(CASE WHEN event_type <> 'view' THEN value < 200 END, false) GROUP BY user_id
""")
def unmet_conditions(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("graph"), F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("label"), F.when(F.col("event_type") != "view", F.col("value") < 200).alias("holds")
    )
    return dispatch.unmet_conditions(checks)


@query("""
    SELECT o_orderkey AS name, o_custkey AS src, coalesce(c_acctbal, CASE WHEN o_orderkey % 2 = 0 THEN -1.0::DOUBLE END) AS value
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
""")
def soft_default(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("src"))
    values = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("value"))
    return dispatch.soft_inputs(orders, values, orders.where("name % 2 = 0").withColumn("value", F.lit(-1.0)))


@query("""
    SELECT o_custkey AS graph, o_orderkey AS name, o_orderstatus || ':' || o_orderkey AS key FROM orders
    WHERE NOT (o_orderkey % 3 <> 0 AND (epoch_us(TIMESTAMP '1996-01-01') - epoch_us(o_orderdate)) / 1e6 <= 63072000)
""")
def resume_pending(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = dispatch.storage_key(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("key")
    state = orders.where("o_orderkey % 3 <> 0").select(key, runs.seconds("o_orderdate").alias("ts"))
    live = dispatch.live_state(state, F.lit((datetime(1996, 1, 1) - datetime(1970, 1, 1)).total_seconds()), 63072000.0)
    return dispatch.resume_pending(orders.select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("name"), key), live)


# -- task runs: a run for each user, a task for each event -----------------------------------------------------------


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.floor(F.col("value") * 1000)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    begin = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("name"), status.alias("status"), (F.col("event_id") % 3 + 1).cast("int").alias("attempts"), begin.alias("started_at"),
        F.timestamp_micros(F.unix_micros(begin) + length * 1000).alias("finished_at"), (length / 1000.0).alias("duration"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("reason"),
    )


_RUNS = """
    r AS (SELECT user_id AS run_id, lpad(event_id::VARCHAR, 12, '0') AS name, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status,
                 (event_id % 3 + 1)::INTEGER AS attempts, epoch_us(ts) AS b, epoch_us(ts) + floor(value * 1000)::BIGINT * 1000 AS f, floor(value * 1000)::BIGINT / 1000.0::DOUBLE AS duration FROM events)
"""


@query(f"WITH {_RUNS} SELECT run_id, status, count(*) AS n, round(sum(duration), 6) AS total_duration FROM r GROUP BY run_id, status")
def run_summary(spark, sf_dir):
    return runs.summary(event_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT run_id, name, status FROM r WHERE status IN ('failed', 'skipped')")
def tasks_by_status(spark, sf_dir):
    return runs.by_status(event_runs(spark, sf_dir), "failed", "skipped").select("run_id", "name", "status")


@query(f"WITH {_RUNS} SELECT run_id, name, CASE WHEN status = 'skipped' THEN 0.0::DOUBLE ELSE (f - b) / 1e6 END AS duration FROM r")
def durations(spark, sf_dir):
    stamped = event_runs(spark, sf_dir).withColumn("finished_at", F.when(F.col("status") != "skipped", F.col("finished_at")))
    return runs.durations(runs.duration(stamped))


@query(f"WITH {_RUNS} SELECT run_id, name, duration, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration DESC, name)::INTEGER AS place FROM r) WHERE place <= 3")
def top_bottlenecks(spark, sf_dir):
    return runs.bottlenecks(event_runs(spark, sf_dir), 3)


@query(f"WITH {_RUNS} SELECT run_id, (max(f) - min(b)) / 1e6 AS wall FROM r GROUP BY run_id")
def wall_clock(spark, sf_dir):
    return runs.wall_clock(event_runs(spark, sf_dir))


@query(f"""
    WITH {_RUNS} SELECT run_id, name, CASE WHEN status = 'skipped' THEN 0.0::DOUBLE ELSE coalesce(greatest(0.0::DOUBLE, (b - lag(f) OVER (PARTITION BY run_id ORDER BY name)) / 1e6), 0.0::DOUBLE) END AS wait FROM r
""")
def wait_time(spark, sf_dir):
    made = event_runs(spark, sf_dir)
    chain = graphs.chain_edges(made.withColumnRenamed("run_id", "graph"), "name").withColumnRenamed("graph", "run_id")
    return runs.wait_times(made, chain)


_SWEEP = """
    o AS (SELECT run_id, b / 1e6 AS b, f / 1e6 AS f FROM r WHERE status <> 'skipped' AND f > b),
    m AS (SELECT run_id, t, sum(d) AS d FROM (SELECT run_id, b AS t, 1 AS d FROM o UNION ALL SELECT run_id, f, -1 FROM o) GROUP BY run_id, t),
    l AS (SELECT run_id, sum(d) OVER (PARTITION BY run_id ORDER BY t) AS level FROM m),
    s AS (SELECT o.run_id, (SELECT max(level) FROM l WHERE l.run_id = o.run_id)::BIGINT AS peak, sum(f - b) / (max(f) - min(b)) AS average FROM o GROUP BY o.run_id)
"""


@query(f"WITH {_RUNS}, {_SWEEP} SELECT run_id, peak, round(average, 6) AS average FROM s")
def parallelism(spark, sf_dir):
    return runs.parallelism(runs.run_spans(event_runs(spark, sf_dir))).withColumn("average", F.round("average", 6))


@query(f"""
    WITH {_RUNS}, v AS (
      SELECT run_id, name, 'running' AS status, 0 AS attempts, b AS at_us, 0 AS started FROM r WHERE status <> 'skipped'
      UNION ALL SELECT run_id, name, status, attempts, f, 1 FROM r)
    SELECT run_id, name, status, attempts::INTEGER AS attempts, at_us, row_number() OVER (PARTITION BY run_id ORDER BY at_us, started, name)::INTEGER AS seq FROM v
""")
def event_log(spark, sf_dir):
    return dispatch.event_log(event_runs(spark, sf_dir)).select("run_id", "name", "status", "attempts", micros("ts").alias("at_us"), "seq")


# -- whole profiles, over conversations ------------------------------------------------------------------------------


def turn_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turn k starts 200 k seconds after midnight and lasts as long as its text, in tenths of seconds and 2 ** k thousandths."""
    nodes, edges = turn_graph(spark, sf_dir)
    begin = F.lit(1_704_067_200_000_000) + F.col("turn") * 200_000_000
    length = F.col("chars") * 100_000 + F.pow(F.lit(2.0), F.col("turn")).cast("long") * 1000
    made = nodes.select(
        F.col("graph").alias("run_id"), "name", F.lit("success").alias("status"), F.lit(1).alias("attempts"), F.timestamp_micros(begin).alias("started_at"), F.timestamp_micros(begin + length).alias("finished_at"),
        (length / 1e6).alias("duration"),
    )
    return made, edges.withColumnRenamed("graph", "run_id")


_TURN_RUNS = """
    n AS (SELECT conv_id AS run_id, turn AS node, 1704067200000000 + turn * 200000000 AS b, length(text) * 100000 + power(2, turn)::BIGINT * 1000 AS len FROM conversations),
    e AS (SELECT b.run_id, a.node AS src, b.node AS dst, CASE WHEN a.node = b.node - 1 THEN 0 ELSE 1 END AS pos FROM n a JOIN n b ON a.run_id = b.run_id AND ((a.node = b.node - 1 AND b.node % 3 <> 0) OR a.node = b.node - 2)),
    w AS (SELECT n.*, greatest(0, coalesce(n.b - max(d.b + d.len), 0)) AS wait FROM n LEFT JOIN e ON e.run_id = n.run_id AND e.dst = n.node LEFT JOIN n d ON d.run_id = e.run_id AND d.node = e.src GROUP BY n.run_id, n.node, n.b, n.len)
"""
_TURN_CRITICAL = _TURN_RUNS + """,
    p AS (SELECT run_id, node, len AS total, [node] AS path FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = n.run_id AND e.dst = n.node)
          UNION SELECT p.run_id, e.dst, total + len, list_append(path, e.dst) FROM p JOIN e ON e.run_id = p.run_id AND e.src = p.node JOIN n ON n.run_id = e.run_id AND n.node = e.dst),
    c AS (SELECT run_id, max(total) AS total, arg_max(path, total) AS path FROM p GROUP BY run_id)
"""


@query(f"""
    WITH RECURSIVE {_TURN_CRITICAL}
    SELECT w.run_id, w.node::VARCHAR AS name, 'success' AS status, len / 1e6 AS duration, 1 AS attempts, round(wait / 1e6, 6) AS wait, list_contains(c.path, w.node) AS critical,
           coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY pos) FROM e WHERE e.run_id = w.run_id AND e.dst = w.node), '') AS needs
    FROM w JOIN c USING (run_id)
""")
def task_profile(spark, sf_dir):
    return runs.profile(*turn_runs(spark, sf_dir)).withColumns({"needs": F.array_join("needs", ","), "wait": F.round("wait", 6)})


@query(f"""
    WITH RECURSIVE {_TURN_CRITICAL},
    o AS (SELECT run_id, b, b + len AS f FROM n WHERE len > 0),
    m AS (SELECT run_id, t, sum(d) AS d FROM (SELECT run_id, b AS t, 1 AS d FROM o UNION ALL SELECT run_id, f, -1 FROM o) GROUP BY run_id, t),
    l AS (SELECT run_id, sum(d) OVER (PARTITION BY run_id ORDER BY t) AS level FROM m),
    s AS (SELECT run_id, max(level)::BIGINT AS peak FROM l GROUP BY run_id),
    t AS (SELECT run_id, (max(f) - min(b)) / 1e6 AS wall, sum(f - b) / 1e6 AS area FROM o GROUP BY run_id)
    SELECT t.run_id, round(wall, 6) AS wall, round(c.total / 1e6, 6) AS critical, round((c.total / 1e6) / wall, 4) AS efficiency, s.peak, round(area / wall, 4) AS average,
           round((SELECT sum(wait) FROM w WHERE w.run_id = t.run_id) / 1e6, 6) AS waiting
    FROM t JOIN c USING (run_id) JOIN s USING (run_id)
""")
def run_profile(spark, sf_dir):
    return runs.run_profile(*turn_runs(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {_TURN_RUNS},
    g AS (SELECT run_id, node, len + wait AS total FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = w.run_id AND e.dst = w.node)
          UNION SELECT g.run_id, e.dst, total + len + wait FROM g JOIN e ON e.run_id = g.run_id AND e.src = g.node JOIN w ON w.run_id = e.run_id AND w.node = e.dst),
    x AS (SELECT run_id, node, max(total) AS f FROM g GROUP BY run_id, node),
    y AS (SELECT x.run_id, x.node, f - len AS b, f, min(f - len) OVER r AS first, max(f) OVER r AS last FROM x JOIN n ON n.run_id = x.run_id AND n.node = x.node WINDOW r AS (PARTITION BY x.run_id))
    SELECT run_id, node::VARCHAR AS name, round(b / 1e6, 3) AS "begin", round(f / 1e6, 3) AS "end", round((b - first) / (last - first) * 100, 4) AS left_pct, round((f - b) / (last - first) * 100, 4) AS width_pct FROM y
""")
def gantt(spark, sf_dir):
    bars = runs.gantt(*turn_runs(spark, sf_dir))
    return bars.select("run_id", "name", *[F.round(c, 3).alias(c) for c in ("begin", "end")], "left_pct", "width_pct")


# -- one run, or one graph, that holds everything: swept in parts, walked in few rounds -----------------------------

def one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(spark, sf_dir).withColumn("run_id", F.lit(1))


@query(f"WITH {_RUNS.replace('user_id AS run_id', '1 AS run_id')}, {_SWEEP} SELECT run_id, peak, round(average, 6) AS average FROM s")
def one_run_parallelism(spark, sf_dir):
    return runs.parallelism(runs.run_spans(one_run(spark, sf_dir)), rows=PART).withColumn("average", F.round("average", 6))


@query(f"""
    WITH {_RUNS.replace('user_id AS run_id', '1 AS run_id')}, v AS (
      SELECT run_id, name, 'running' AS status, b AS at_us, 0 AS started FROM r WHERE status <> 'skipped'
      UNION ALL SELECT run_id, name, status, f, 1 FROM r)
    SELECT run_id, name, status, at_us, row_number() OVER (ORDER BY at_us, started, name)::INTEGER AS seq FROM v
""")
def one_run_event_log(spark, sf_dir):
    return dispatch.event_log(one_run(spark, sf_dir), rows=PART).select("run_id", "name", "status", micros("ts").alias("at_us"), "seq")


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one chain, each needing the one before it."""
    nodes = table(spark, sf_dir, "events").select(F.lit(1).alias("graph"), "ts", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("name"))
    return graphs.chain_edges(nodes, "ts", rows=PART)


@query("SELECT 1 AS graph, lag(lpad(event_id::VARCHAR, 12, '0')) OVER (ORDER BY ts, event_id) AS src, lpad(event_id::VARCHAR, 12, '0') AS dst FROM events QUALIFY src IS NOT NULL")
def one_run_chain(spark, sf_dir):
    return event_chain(spark, sf_dir).select("graph", "src", "dst")


@query(f"""
    WITH {_RUNS.replace('user_id AS run_id', '1 AS run_id')},
    w AS (SELECT *, CASE WHEN status = 'skipped' THEN 0 ELSE greatest(0, coalesce(b - lag(f) OVER (ORDER BY b, name), 0)) END AS wait FROM r),
    t AS (SELECT *, sum(f - b + wait) OVER (ORDER BY b, name) AS ends FROM w)
    SELECT run_id, name, round((ends - (f - b)) / 1e6, 6) AS "begin", round(ends / 1e6, 6) AS "end" FROM t
""")
def one_run_gantt(spark, sf_dir):
    bars = runs.gantt(one_run(spark, sf_dir), event_chain(spark, sf_dir).withColumnRenamed("graph", "run_id"))
    return bars.select("run_id", "name", *[F.round(c, 6).alias(c) for c in ("begin", "end")])


def type_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph for each type of event: a chain of its events by id."""
    nodes = table(spark, sf_dir, "events").select(F.col("event_type").alias("graph"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("name"), "event_id", (F.floor(F.col("value") * 8) / 8).alias("weight"))
    return nodes, graphs.chain_edges(nodes, "name", rows=PART)


_TYPES = "t AS (SELECT event_type AS graph, lpad(event_id::VARCHAR, 12, '0') AS name, event_id, floor(value * 8) / 8 AS weight FROM events)"


@query(f"WITH {_TYPES} SELECT graph, name, (row_number() OVER c - 1)::INTEGER AS layer, sum(weight) OVER c AS total, lag(name) OVER c AS before FROM t WINDOW c AS (PARTITION BY graph ORDER BY name)")
def deep_paths(spark, sf_dir):
    return graphs.heaviest(*type_chains(spark, sf_dir), "weight")


@query(f"WITH {_TYPES} SELECT graph, name, sum(weight) OVER (PARTITION BY graph) AS total FROM t QUALIFY name <= max(CASE WHEN weight > 0 THEN name END) OVER (PARTITION BY graph)")
def deep_critical_nodes(spark, sf_dir):
    return graphs.critical_nodes(*type_chains(spark, sf_dir), "weight").select("graph", "name", "total")


@query(f"""
    WITH {_TYPES}, k AS (SELECT *, max(CASE WHEN event_id % 500 = 3 THEN name END) OVER c AS stop, max(CASE WHEN event_id % 500 = 250 THEN name END) OVER c AS pass, lag(name) OVER (PARTITION BY graph ORDER BY name) AS need
                         FROM t WINDOW c AS (PARTITION BY graph ORDER BY name))
    SELECT graph, name, CASE WHEN event_id % 500 = 3 THEN 'failed' WHEN stop IS NOT NULL AND (pass IS NULL OR pass < stop) THEN 'skipped' ELSE 'success' END AS status,
           CASE WHEN event_id % 500 <> 3 AND stop IS NOT NULL AND (pass IS NULL OR pass < stop) THEN need END AS cause FROM k
""")
def deep_skips(spark, sf_dir):
    nodes, edges = type_chains(spark, sf_dir)
    status = F.when(F.col("event_id") % 500 == 3, "failed").otherwise("success").alias("status")
    return dispatch.skip_propagation(nodes.select("graph", "name", status, (F.col("event_id") % 500 == 250).alias("tolerant")), edges)


# -- cycles: turns that go back to earlier ones ----------------------------------------------------------------------


def turn_cycles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turn k leads to turn k + 1, and back to turn k - 2 if its text has a length divisible by 3; names keep the order of turns."""
    turns = table(spark, sf_dir, "conversations")
    nodes = turns.select(F.col("conv_id").alias("graph"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("name"), "turn", (F.length("text") % 3 == 0).alias("back"))
    to = F.explode(F.array(F.col("turn") + 1, F.when(F.col("back"), F.col("turn") - 2))).alias("to")
    edges = nodes.select("graph", F.col("name").alias("src"), to).where("to IS NOT NULL")
    return nodes, graphs.prune_edges(nodes, edges.select("graph", "src", F.lpad(F.col("to").cast("string"), 4, "0").alias("dst")))


_CYCLES = """
    n AS (SELECT conv_id AS graph, turn AS node, length(text) % 3 = 0 AS back FROM conversations),
    e AS (SELECT a.graph, a.node AS src, b.node AS dst FROM n a JOIN n b ON a.graph = b.graph AND (b.node = a.node + 1 OR a.back AND b.node = a.node - 2)),
    reach AS (SELECT graph, src, dst FROM e UNION SELECT r.graph, r.src, e.dst FROM reach r JOIN e ON e.graph = r.graph AND e.src = r.dst),
    c AS (SELECT a.graph, a.src AS node, min(a.dst) AS low FROM reach a JOIN reach b ON a.graph = b.graph AND a.src = b.dst AND a.dst = b.src GROUP BY a.graph, a.src)
"""


@query(f"WITH RECURSIVE {_CYCLES} SELECT graph, lpad(node::VARCHAR, 4, '0') AS name, lpad(low::VARCHAR, 4, '0') AS component FROM c")
def cycle_members(spark, sf_dir):
    return cycles.components(*turn_cycles(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {_CYCLES},
    f AS (SELECT graph, low, low AS node, 0 AS dist FROM c WHERE node = low
          UNION SELECT f.graph, f.low, e.dst, dist + 1 FROM f JOIN e ON e.graph = f.graph AND e.src = f.node WHERE dist < 60 AND (dist = 0 OR f.node <> f.low))
    SELECT c.graph, lpad(c.low::VARCHAR, 4, '0') AS component, count(DISTINCT c.node) AS members, min(dist)::INTEGER AS length
    FROM c JOIN f ON f.graph = c.graph AND f.low = c.low AND f.node = f.low AND dist > 0 GROUP BY c.graph, c.low
""")
def shortest_cycles(spark, sf_dir):
    return cycles.shortest_cycles(*turn_cycles(spark, sf_dir)).select("graph", "component", "members", "length")


# -- tasks in time: overlaps, the last before, and pages far behind --------------------------------------------------


@query(f"WITH {_RUNS} SELECT a.run_id, a.name AS first, b.name AS second, least(a.f, b.f) - greatest(a.b, b.b) AS shared_us FROM r a JOIN r b ON a.run_id = b.run_id AND a.name < b.name AND a.b < b.f AND b.b < a.f WHERE a.f > a.b AND b.f > b.b")
def overlapping_tasks(spark, sf_dir):
    spans = event_runs(spark, sf_dir).select("run_id", "name", micros("started_at").alias("begin"), micros("finished_at").alias("end"))
    pairs = overlaps.overlapping(spans, spans, ["run_id"], 60e6, F.col("left.name") < F.col("right.name"))
    shared = F.least("left.end", "right.end") - F.greatest("left.begin", "right.begin")
    return pairs.select("run_id", F.col("left.name").alias("first"), F.col("right.name").alias("second"), shared.alias("shared_us"))


@query(f"WITH {_RUNS} SELECT a.run_id, a.name, coalesce(z.f, 0) AS last_finish FROM r a ASOF LEFT JOIN (SELECT DISTINCT run_id, f FROM r) z ON a.run_id = z.run_id AND a.b >= z.f")
def last_finish(spark, sf_dir):
    made = event_runs(spark, sf_dir)
    starts = made.select("run_id", "name", micros("started_at").alias("at"))
    ends = made.select("run_id", micros("finished_at").alias("at"), micros("finished_at").alias("finish"))
    return overlaps.as_of(starts, ends, ["run_id"], "at", "finish", name="last_finish", rows=PART).select("run_id", "name", F.coalesce("last_finish", F.lit(0)).alias("last_finish"))


@query("SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 500 OFFSET (SELECT count(*) // 2 FROM lineitem)")
def deep_page(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return relational.deep_page(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], 500, lines.count() // 2, rows=PART)


# -- archives --------------------------------------------------------------------------------------------------------


@query("""
    WITH m AS (SELECT doc_id, encode(rtrim('Subject: ' || coalesce(source, '') || chr(10) || chr(10) || coalesce(text, ''), chr(13) || chr(10))) AS content FROM documents)
    SELECT coalesce(doc_id::VARCHAR, '-') AS envelope, md5(content) AS file_hash, octet_length(content) AS file_size FROM m
""")
def archive_messages(spark, sf_dir):
    """All documents as messages of archives, one file for each partition, and the messages of these files."""
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.lit("Subject: "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    out = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.write_archive(docs.select(F.col("doc_id").cast("string").alias("envelope"), content.alias("content")), out)
    return archive.read_archive(spark, out).select("envelope", F.md5("content").alias("file_hash"), "file_size")


# -- streaming -------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All of ``events`` as a stream that ends: its result, from a table in the shared folder."""
    events = table(spark, sf_dir, "events")
    out = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    writer = made(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")).writeStream
    writer = writer.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
    part = (lambda k: "all") if mode == "complete" else str  # a batch that is repeated after a failure replaces itself
    writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows/batch={part(k)}")).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(*made(events).columns)


@query("""
    SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS begin, event_type AS status, count(*) AS n FROM events GROUP BY ALL
""")
def stream_status_counts(spark, sf_dir):
    counted = _streamed(spark, sf_dir, lambda df: task_events.status_counts(df, window="1 day", status_col="event_type"), "complete")
    return counted.select(micros("begin").alias("begin"), "status", "n")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_without_repeats(spark, sf_dir):
    made = lambda df: task_events.without_repeats(df.union(df), ["event_id"], late="2 days").select("event_id", "user_id", "event_type")
    return _streamed(spark, sf_dir, made, "append")


@query("""
    WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL),
    l AS (SELECT user_id, event_id, event_type, ms, count(*) OVER (PARTITION BY user_id) AS events FROM e
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT user_id::VARCHAR AS task, event_id AS seq, event_type AS status, ms AS "at", events,
           coalesce(event_type NOT IN ('purchase', 'signup'), true) AND ms + 3600000 <= (SELECT max(ms) FROM e) - 600000 AS stuck
    FROM l
""")
def stream_live_tasks(spark, sf_dir):
    def made(events: DataFrame) -> DataFrame:
        task = events.select(F.lit("all").alias("run_id"), F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("int").alias("attempts"), "ts")
        return live.watch(task, stuck=3600, keep=1e9, final=("purchase", "signup"))

    return live.current(_streamed(spark, sf_dir, made, "update")).select("task", "seq", "status", "at", "events", "stuck")
