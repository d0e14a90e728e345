"""Running values in parts, walks over deep graphs, cycles, overlaps and far pages against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import chains, cycles, dispatch, graphs, overlaps, relational, runs, scans

EDGE = "graph int, src string, dst string, kind string, pos int"


@pytest.mark.parametrize("part", [30, 10_000])
def test_running_values_equal_windows(spark, part):
    rng = random.Random(part)
    table = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), k, rng.choice([None, k % 7, -k % 5])) for k in range(300)]
    df = spark.createDataFrame(table, "key string, at int, x int").repartition(3)
    got = scans.running(df, ["key"], ["at"], sums={"total": F.col("x")}, previous={"back": "x"}, latest={"seen": "x"}, place="n", rows=part)
    own = Window.partitionBy("key").orderBy("at")
    want = df.select("*", F.coalesce(F.sum("x").over(own), F.lit(0)), F.row_number().over(own), F.lag("x").over(own), F.last("x", True).over(own))
    assert got.columns == ["key", "at", "x", "total", "n", "back", "seen"]
    assert rows(got) == rows(want)


def test_one_key_is_scanned_in_many_tasks(spark):
    df = spark.range(2000).select(F.lit(1).alias("key"), "id")
    got = scans.running(df, ["key"], ["id"], place="n", rows=100)
    assert rows(got.select("id", "n")) == sorted([(k, k + 1) for k in range(2000)], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "scan part" in plan and "BroadcastHashJoin" in plan
    assert rows(scans.running(df.limit(0), ["key"], ["id"], place="n", rows=100)) == []


def test_peak_of_one_run_in_parts(spark):
    rng = random.Random(1)
    spans = [(1, b := rng.randrange(1000), b + rng.randrange(40)) for _ in range(500)]
    df = spark.createDataFrame([(r, float(b), float(e)) for r, b, e in spans], "run_id int, begin double, end double")
    want = max(sum(b <= t < e for _, b, e in spans) for _, t, _ in spans)
    assert runs.parallelism(df, rows=60).first()["peak"] == runs.parallelism(df).first()["peak"] == want


# -- graphs ----------------------------------------------------------------------------------------------------------


def graph(spark, pairs, names, number=1):
    nodes = spark.createDataFrame([(number, n, float(w)) for n, w in names], "graph int, name string, weight double")
    return nodes, spark.createDataFrame([(number, s, d, "hard", k) for k, (s, d) in enumerate(pairs)], EDGE)


def random_dag(rng, n):
    """Chains, merges and branches: most nodes need the one before, some need others too."""
    return [(f"n{j:03d}", f"n{k:03d}") for k in range(1, n) for j in {k - 1 if rng.random() < 0.85 else rng.randrange(k), *([rng.randrange(k)] if rng.random() < 0.2 else [])}]


@pytest.mark.parametrize("seed", [1])
def test_heaviest_paths_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs, names = random_dag(rng, 40), [(f"n{k:03d}", rng.randrange(1, 100)) for k in range(40)]
    nodes, edges = graph(spark, pairs, names)
    weight, layer, best, before = dict(names), {}, {}, {}
    for n, w in names:
        needs = [(best[s], k, s) for k, (s, d) in enumerate(pairs) if d == n]
        layer[n] = 1 + max((layer[s] for _, _, s in needs), default=-1)
        best[n], before[n] = w + max(needs, default=(0,))[0], max(needs, default=(0, 0, None))[2]
    assert rows(graphs.heaviest(nodes, edges, "weight").drop("graph")) == sorted([(n, layer[n], float(best[n]), before[n]) for n in weight], key=repr)
    end = min(weight, key=lambda n: (-best[n], layer[n], n))
    path = [end]
    while before[path[0]]:
        path.insert(0, before[path[0]])
    assert graphs.critical_path(nodes, edges, "weight").first()["path"] == path
    whole = {r["name"]: r["path"] for r in graphs.longest_paths(nodes, edges, "weight").collect()}
    assert len(whole) == 40 and all(p[-1] == n and sum(weight[x] for x in p) == best[n] for n, p in whole.items())


@pytest.mark.parametrize("seed", [3])
def test_skips_and_reach_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs, names = random_dag(rng, 80), [(f"n{k:03d}", 1) for k in range(80)]
    pairs += [("n070", "n010"), ("n040", "n041"), ("gone", "n005")]  # a cycle, an edge twice, a need that isn't there
    nodes, edges = graph(spark, pairs, names)
    status = {n: rng.choice(["failed", "skipped"] + ["success"] * 20) for n, _ in names}
    tolerant = {n for n, _ in names if rng.random() < 0.1}
    dist, front, level = {n: 0 for n in status if status[n] != "success"}, {n for n in status if status[n] != "success"}, 0
    cause = {}
    while front:
        level, nexts = level + 1, defaultdict(set)
        for s, d in pairs:
            if s in front and d in status and d not in dist and d not in tolerant:
                nexts[d].add(s)
        cause |= {d: min(s) for d, s in nexts.items()}
        dist |= dict.fromkeys(nexts, level)
        front = set(nexts)
    statuses = spark.createDataFrame([(1, n, status[n], n in tolerant) for n in status], "graph int, name string, status string, tolerant boolean")
    want = [(n, "skipped" if n in cause else status[n], cause.get(n)) for n in status]
    assert rows(dispatch.skip_propagation(statuses, edges).drop("graph")) == sorted(want, key=repr)
    seen, todo = set(), ["n020", "n055"]
    while todo:
        if (n := todo.pop()) not in seen:
            seen.add(n)
            todo += [d for s, d in pairs if s == n]
    assert {r["name"] for r in graphs.downstream(nodes.where("name IN ('n020', 'n055')"), edges).collect()} == seen


def test_a_chain_of_100000_nodes_takes_few_rounds(spark, monkeypatch):
    made = []
    write = chains.written
    monkeypatch.setattr(chains, "written", lambda df, label: made.append(label) or write(df, label))
    count = chains.counted
    monkeypatch.setattr(chains, "counted", lambda df, label, which=None: made.append(label) or count(df, label, which))
    n = 100_000
    nodes = spark.range(n).select(F.lit(1).alias("graph"), F.lpad(F.col("id").cast("string"), 6, "0").alias("name"), (F.col("id") % 5).cast("double").alias("weight"), "id")
    edges = nodes.where("id > 0").select("graph", F.lpad((F.col("id") - 1).cast("string"), 6, "0").alias("src"), F.col("name").alias("dst"), F.lit("hard").alias("kind"), F.lit(0).alias("pos"))
    got = graphs.critical_nodes(nodes, edges, "weight")
    assert got.agg(F.count("*"), F.max("total"), F.countDistinct("step", "place")).first() == (n, 200_000.0, n)
    assert len(made) < 60
    made.clear()
    statuses = nodes.select("graph", "name", F.when(F.col("id") == 10, "failed").otherwise("success").alias("status"), (F.col("id") == 90_000).alias("tolerant"))
    assert dispatch.skip_propagation(statuses, edges).where("status = 'skipped'").agg(F.count("*"), F.min("name"), F.max("name")).first() == (89_989, "000011", "089999")
    assert len(made) < 60


# -- cycles ----------------------------------------------------------------------------------------------------------


def plain_components(pairs):
    reach = {(s, d) for s, d in pairs}
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    return {a: min(b for x, b in reach if x == a and (b, a) in reach) for a, b in reach if a == b}


@pytest.mark.parametrize("seed", [1])
def test_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(40)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(38)} | {("n00", "n00"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1")})
    nodes, edges = graph(spark, pairs, [(n, 1) for n in [*names, "r1", "r2", "r3"]])
    want = plain_components(pairs)
    assert {r["name"]: r["component"] for r in cycles.components(nodes, edges).collect()} == want
    found = cycles.shortest_cycles(nodes, edges).collect()
    assert {r["component"]: r["members"] for r in found} == {c: list(want.values()).count(c) for c in set(want.values())}
    for r in found:
        path, inside = r["path"], {n for n, c in want.items() if c == r["component"]}
        assert path[0] == path[-1] == r["component"] and len(path) == r["length"] + 1 and set(zip(path, path[1:])) <= set(pairs)
        front, level = {path[0]}, 0
        while level == 0 or path[0] not in front:
            front, level = {d for s, d in pairs if s in front and d in inside}, level + 1
        assert level == r["length"]


def test_a_long_ring_and_graphs_without_cycles(spark):
    n = 300
    nodes, edges = graph(spark, [(f"n{k:04d}", f"n{(k + 1) % n:04d}") for k in range(n)], [(f"n{k:04d}", 1) for k in range(n)])
    (row,) = cycles.shortest_cycles(nodes, edges).collect()
    assert (row["component"], row["members"], row["length"], len(row["path"])) == ("n0000", n, n, n + 1)
    assert rows(cycles.components(nodes, edges.where("src <> 'n0100'"))) == []
    assert rows(cycles.shortest_cycles(nodes, edges.limit(0))) == []


# -- time and pages --------------------------------------------------------------------------------------------------


def test_overlaps_and_last_values_equal_brute_force(spark):
    rng = random.Random(6)
    spans = [(rng.choice("hhha"), k, float(b := rng.randrange(300)), float(b + rng.choice([0, 1, 5, 90]))) for k in range(200)]
    df = spark.createDataFrame(spans, "key string, k int, begin double, end double")
    want = sorted((a[1], b[1]) for a in spans for b in spans if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    for width in (3.0, 1000.0):
        got = overlaps.overlapping(df, df, ["key"], width, F.col("left.k") < F.col("right.k"))
        assert sorted((r["left"]["k"], r["right"]["k"]) for r in got.collect()) == want
    for strict in (False, True):
        left = df.select("key", "k", F.col("begin").alias("at"))
        right = df.select("key", F.col("end").alias("at"), F.when(F.col("k") % 9 > 0, F.col("k")).alias("v"))
        got = overlaps.as_of(left, right, ["key"], "at", "v", strict=strict, rows=30)
        last = lambda s: max(((e, k) for key, k, _, e in spans if key == s[0] and k % 9 and (e < s[2] or e == s[2] and not strict)), default=(0, None))[1]
        assert rows(got.select("k", "before")) == sorted([(s[1], last(s)) for s in spans], key=repr)


def test_far_pages_equal_a_sort(spark):
    rng = random.Random(7)
    table = sorted(((rng.choice([None, 1, 1, 1, rng.randrange(50)]), k) for k in range(3000)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    df = spark.createDataFrame(table, "a int, b int").repartition(4)
    for offset in (0, 10, 1499, 2990, 5000):
        got = [tuple(r) for r in relational.deep_page(df, ["a", "b"], 20, offset, rows=200, sample=300, parts=8).collect()]
        assert got == table[offset : offset + 20]


def test_far_pages_keep_few_rows_and_find_nulls(spark, monkeypatch):
    """Each turn keeps a small share of the rows, also where most keys are null and where the first column says little."""
    rng, kept, written = random.Random(8), [], relational.written
    monkeypatch.setattr(relational, "written", lambda df, label: kept.append(made := written(df, label)) or made)
    table = [(None if rng.random() < 0.7 else rng.choice([1.5, float("nan"), -2.0]), rng.choice([None, "a", "b", "ä"]), k) for k in range(20_000)]
    df = spark.createDataFrame(table, "a double, b string, c int").repartition(4)
    every = [tuple(map(str, r)) for r in df.orderBy("a", "b", "c").collect()]
    for offset in (0, 30, 6_990, 10_000, 13_999, 17_003, 19_990, 20_000, 30_000):
        del kept[:]
        got = relational.deep_page(df, ["a", "b", "c"], 25, offset, rows=300, sample=2000, parts=16)
        assert [tuple(map(str, r)) for r in got.collect()] == every[offset : offset + 25], offset
        assert offset >= 20_000 or len(kept) > 0 and got.inputFiles()


def test_a_far_page_is_found_when_the_sample_misleads(spark):
    """A sample of rows that all stand elsewhere costs another scan, and nothing is lost; neither with ties all over."""
    df = spark.range(5000).withColumn("a", (F.col("id") % 3).cast("int")).repartition(3)
    every = [tuple(r) for r in df.select("a", "id").orderBy("a", "id").collect()]
    for sample, parts in ((12, 2), (40, 1000), (5000, 5000)):
        for offset, limit in ((0, 1), (1660, 20), (2500, 2000), (4990, 50), (10, 0)):
            got = relational.deep_page(df.select("a", "id"), ["a", "id"], limit, offset, rows=50, sample=sample, parts=parts)
            assert [tuple(r) for r in got.collect()] == every[offset : offset + limit]
    ties = df.select(F.lit(1).alias("x"))
    assert relational.deep_page(ties, ["x"], 10, 3000, rows=50).count() == 10
