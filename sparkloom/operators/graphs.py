"""Task graphs as tables: ``nodes(graph, name, ...)`` and ``edges(graph, src, dst, kind, pos)``.

``src`` is needed by ``dst``; ``kind`` is ``hard`` or ``soft``; ``pos`` orders the needs of a node. Soft edges carry values,
not order: layers and paths follow hard edges only. Many graphs are worked on at once: all joins and groups are by
(graph, name). Operators that follow edges contract chains first (``chains``), keep a frontier and write their rounds to
the shared folder, so plans don't grow with depth and what is done isn't touched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import CyclicGraph
from sparkloom.operators import chains, scans
from sparkloom.session import written

KEY = ["graph", "name"]


def edges_of(nodes: DataFrame, needs_col: str = "needs", kind: str = "hard") -> DataFrame:
    """Edges from a column that lists what each node needs."""
    return nodes.select("graph", F.col("name").alias("dst"), F.posexplode(needs_col).alias("pos", "src")).select("graph", "src", "dst", F.lit(kind).alias("kind"), "pos")


def chain_edges(nodes: DataFrame, order_col: str, rows: int = scans.ROWS) -> DataFrame:
    """Each node needs the one before it."""
    order = [order_col] if order_col == "name" else [order_col, "name"]
    made = scans.running(nodes.select("graph", *dict.fromkeys([*order, "name"])), ["graph"], order, previous={"src": "name"}, rows=rows)
    return made.where("src IS NOT NULL").select("graph", "src", F.col("name").alias("dst"), F.lit("hard").alias("kind"), F.lit(0).alias("pos"))


def fan_out(nodes: DataFrame, items: DataFrame, item_col: str = "item", rows: int = scans.ROWS) -> DataFrame:
    """One node for each item of its graph, named ``name[k]`` by the item's order; the item comes along."""
    numbered = scans.running(items, ["graph"], [item_col], place="place", rows=rows).withColumn("k", (F.col("place") - 1).cast("int")).drop("place")
    return nodes.join(numbered, "graph").withColumn("name", F.concat("name", F.lit("["), F.col("k").cast("string"), F.lit("]")))


def missing_inputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, hard or soft, of which one end isn't a node."""
    ends = edges.select("*", F.explode(F.array("src", "dst")).alias("name"))
    return ends.join(nodes.select(KEY), KEY, "left_anti").select("graph", "src", "dst", "kind", F.col("name").alias("missing"))


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1")


def hard(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'hard'")


def _ordered(nodes: DataFrame, edges: DataFrame, weight: Column) -> DataFrame:
    """What ``chains.ordered`` tells of these nodes over ``edges``, whatever their kind."""
    weighted = nodes.select(*KEY, weight.alias("weight")).groupBy(KEY).agg(F.max("weight").alias("weight"))
    return chains.ordered(weighted.withColumn("cut", F.lit(False)), edges.select("graph", "src", "dst", "pos"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, name, layer): 0 for nodes without hard needs, else one more than the highest; null on or behind a cycle."""
    return _ordered(nodes, hard(edges), F.lit(0.0)).select(*KEY, "layer")


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that never become ready: on a cycle, or behind one. Soft edges count too."""
    return _ordered(nodes, edges, F.lit(0.0)).where("layer IS NULL").select(KEY)


def prune_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both among ``nodes``: two semi joins."""
    kept = nodes.select(KEY).distinct()
    by_src = edges.join(kept.withColumnRenamed("name", "src"), ["graph", "src"], "left_semi")
    return by_src.join(kept.withColumnRenamed("name", "dst"), ["graph", "dst"], "left_semi").select(edges.columns)


def subgraph_by_tags(nodes: DataFrame, edges: DataFrame, tags: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes that share any tag, and the edges among them."""
    kept = nodes.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return kept, prune_edges(kept, edges)


def subgraph_by_names(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes listed in ``names(graph, name)``, and the edges among them."""
    kept = nodes.join(names.select(KEY).distinct(), KEY, "left_semi")
    return kept, prune_edges(kept, edges)


def with_namespace(nodes: DataFrame, edges: DataFrame, namespace: str | Column) -> tuple[DataFrame, DataFrame]:
    """The same graph with every name prefixed by ``namespace:``."""
    prefix = F.lit(namespace) if isinstance(namespace, str) else namespace
    named = lambda c: F.concat(prefix, F.lit(":"), F.col(c)).alias(c)
    own = [named("name") if c == "name" else F.col(c) for c in nodes.columns]
    return nodes.select(own), edges.select([named(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])


def split_reference(ref: Column) -> tuple[Column, Column]:
    """The graph and the task (null: all of them) that a reference ``graph`` or ``graph.task`` names."""
    task = F.when(F.contains(ref, F.lit(".")), F.substring(ref, F.instr(ref, ".") + F.lit(1), F.length(ref)))
    return F.substring_index(ref, ".", 1), task


def reference_levels(members: DataFrame) -> DataFrame:
    """(graph, level) of all graphs in ``members(graph, ref)``: 0 without references, null on or behind a circle of them."""
    names = members.select(F.col("graph").cast("string").alias("name")).union(members.select(F.col("ref").cast("string"))).distinct()
    inside = lambda df: df.withColumn("graph", F.lit(0))
    edges = members.select(F.col("ref").cast("string").alias("src"), F.col("graph").cast("string").alias("dst"), F.lit("hard").alias("kind"), F.lit(0).alias("pos")).distinct()
    return layers(inside(names), inside(edges)).select(F.col("name").alias("graph"), F.col("layer").alias("level"))


def _expand_once(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    of_task = F.col("task").isNull() | (F.col("task") == F.col("name"))
    placed = members.join(nodes.withColumnRenamed("graph", "ref").withColumnRenamed("pos", "own_pos"), "ref").where(of_task)
    into_task = F.col("task").isNull() | (F.col("task") == F.col("dst"))
    inner = members.join(edges.withColumnRenamed("graph", "ref").withColumnRenamed("pos", "edge_pos"), "ref").where(into_task)
    ends = placed.groupBy("graph", "pos").agg(F.max_by("name", "own_pos").alias("last"), F.min_by("name", "own_pos").alias("first"))
    # References of a graph are few; the window is over them, not over nodes.
    before = ends.withColumn("src", F.lag("last").over(Window.partitionBy("graph").orderBy("pos"))).where("src IS NOT NULL").select("graph", "pos", "src", "first")
    bound = hard(inner).select("graph", "pos", F.col("dst").alias("name"), F.lit(True).alias("bound")).distinct()
    free = placed.join(before, ["graph", "pos"]).join(bound, ["graph", "pos", "name"], "left").where("bound IS NULL OR name = first")
    links = free.select("graph", "src", F.col("name").alias("dst"), F.lit("hard").alias("kind"), F.lit(-1).alias("pos"))
    own = nodes.join(members.select("graph").distinct(), "graph", "left_semi")
    own_edges = edges.join(members.select("graph").distinct(), "graph", "left_semi")
    lasts = ends.groupBy("graph").agg(F.max_by("last", "pos").alias("ref_last"))
    chained = own.withColumn("before", F.lag("name").over(Window.partitionBy("graph").orderBy("pos"))).join(lasts, "graph", "left")
    serial = chained.select("graph", F.coalesce("before", "ref_last").alias("src"), F.col("name").alias("dst"), F.lit("hard").alias("kind"), F.lit(-1).alias("pos")).where("src IS NOT NULL")
    every = placed.drop("ref", "task").unionByName(own.withColumnRenamed("pos", "own_pos").withColumn("pos", F.lit(None).cast(members.schema["pos"].dataType)), allowMissingColumns=True)
    order = F.row_number().over(Window.partitionBy("graph").orderBy(F.col("pos").asc_nulls_last(), "own_pos")) - 1
    made = every.withColumn("pos", order).drop("own_pos")
    columns = ["graph", "src", "dst", "kind", "pos"]
    there = inner.select("graph", "src", "dst").union(own_edges.select("graph", "src", "dst"))
    linked = links.union(serial).join(there, ["graph", "src", "dst"], "left_anti")
    return made, inner.select("graph", "src", "dst", "kind", F.col("edge_pos").alias("pos")).union(own_edges.select(columns)).union(linked.select(columns))


def expand_references(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs that refer to other graphs, expanded through all levels: nodes and edges of the graphs in ``members``.

    ``members(graph, pos, ref)`` lists in order what a graph is made of; ``ref`` is a graph or ``graph.task``, one task of
    it (as it is there, its needs included). The nodes of a reference come in as they are. Of every reference but the
    first, the first node and all nodes without needs need the last node (by ``pos``) of the reference before it, so
    parallel nodes of one reference stay parallel. A graph's own nodes follow its references, one after the other.
    References that go in a circle raise ``CyclicGraph``.
    """
    if isinstance(members.schema["ref"].dataType, T.StringType):
        ref, task = split_reference(F.col("ref"))
        members = members.select("graph", "pos", ref.alias("ref"), task.alias("task"))
    else:
        members = members.select("graph", "pos", "ref", F.lit(None).cast("string").alias("task"))
    levels = reference_levels(members)
    if bad := levels.where("level IS NULL").orderBy("graph").limit(20).collect():
        raise CyclicGraph([r["graph"] for r in bad])
    deepest = levels.agg(F.max("level")).first()[0] or 0
    at = members.join(levels.withColumnRenamed("graph", "named"), F.col("graph").cast("string") == F.col("named")).drop("named")
    made_nodes, made_edges = None, None
    known_nodes, known_edges = nodes, edges
    for level in range(1, deepest + 1):
        here = at.where(F.col("level") == level).drop("level")
        if level > 1:  # a graph that was expanded stands in for what it was made of
            known_nodes = nodes.join(made_nodes.select("graph").distinct(), "graph", "left_anti").unionByName(made_nodes, allowMissingColumns=True)
            known_edges = edges.join(made_nodes.select("graph").distinct(), "graph", "left_anti").unionByName(made_edges)
        new_nodes, new_edges = _expand_once(here, known_nodes, known_edges)
        if level < deepest:
            new_nodes, new_edges = written(new_nodes, "expanded"), written(new_edges, "expanded")
        made_nodes = new_nodes if made_nodes is None else made_nodes.unionByName(new_nodes, allowMissingColumns=True)
        made_edges = new_edges if made_edges is None else made_edges.unionByName(new_edges)
    if made_nodes is None:
        return nodes.limit(0), edges.limit(0)
    return made_nodes, made_edges


def downstream(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, name) of everything that can be reached from ``seeds`` along edges of any kind, the seeds included."""
    needs = edges.select("graph", "src", "dst", F.lit(0).alias("pos"))
    ends = needs.select("graph", F.explode(F.array("src", "dst")).alias("name"), F.lit(False).alias("start"))
    nodes = ends.union(seeds.select(*KEY, F.lit(True))).groupBy(KEY).agg(F.max("start").alias("start"))
    made = chains.nearest(nodes.withColumns({"weight": F.lit(0.0), "closed": F.lit(False)}), needs)
    return made.where("dist IS NOT NULL").select(KEY)


def heaviest(nodes: DataFrame, edges: DataFrame, weight_col: str) -> DataFrame:
    """(graph, name, layer, total, before): how heavy the heaviest path of hard edges is that ends at a node, and its last need.

    Of needs that tie, the one that is listed last is taken. Nodes on or behind a cycle are left out.
    """
    return _heaviest(nodes, edges, weight_col).where("layer IS NOT NULL").select(*KEY, "layer", "total", "before")


def _heaviest(nodes: DataFrame, edges: DataFrame, weight_col: str) -> DataFrame:
    return _ordered(nodes, hard(edges), F.coalesce(weight_col, F.lit(0.0)).cast("double"))


def longest_paths(nodes: DataFrame, edges: DataFrame, weight_col: str) -> DataFrame:
    """``heaviest`` with the whole ``path`` of each node: as many names as all paths have together. For graphs that aren't deep."""
    made = _heaviest(nodes, edges, weight_col)
    paths = chains.in_order(chains.ways(made, made.where("layer IS NOT NULL").select("graph", F.col("name").alias("end"))), ["graph", "end"])
    return made.join(paths.withColumnRenamed("end", "name"), KEY).select(*KEY, "layer", "total", "path")


def critical_nodes(nodes: DataFrame, edges: DataFrame, weight_col: str) -> DataFrame:
    """(graph, name, total, step, place): the nodes of the heaviest path of each graph, a row for each, and its total.

    Of ends that tie, the first by layer and name. Falling steps, then rising places are the path's order.
    """
    made = _heaviest(nodes, edges, weight_col)
    best = F.min(F.struct((-F.col("total")).alias("less"), "layer", "name")).alias("best")
    ends = made.where("layer IS NOT NULL").groupBy("graph").agg(best).select("graph", F.col("best.name").alias("end"), (-F.col("best.less")).alias("total"))
    return chains.ways(made, ends).join(ends, ["graph", "end"]).select(*KEY, "total", "step", "place")


def critical_path(nodes: DataFrame, edges: DataFrame, weight_col: str) -> DataFrame:
    """(graph, total, path): ``critical_nodes`` as an array for each graph."""
    return chains.in_order(critical_nodes(nodes, edges, weight_col), ["graph", "total"])


def mermaid(nodes: DataFrame, edges: DataFrame, direction: str = "TD") -> DataFrame:
    """(graph, diagram): hard edges solid, soft ones dashed. A diagram is for reading, so each is one string."""
    if direction not in ("TD", "TB", "BT", "LR", "RL"):
        raise ValueError(f"no such direction: {direction}")
    arrow = F.when(F.col("kind") == "soft", " -.-> ").otherwise(" --> ")
    lines = nodes.select("graph", F.lit(0).alias("part"), F.concat(F.lit("    "), "name").alias("line"))
    lines = lines.union(edges.select("graph", F.lit(1), F.concat(F.lit("    "), "src", arrow, "dst")))
    ordered = F.array_sort(F.collect_list(F.struct("part", "line")))
    return lines.groupBy("graph").agg(F.concat_ws("\n", F.lit(f"graph {direction}"), F.array_join(ordered["line"], "\n")).alias("diagram"))


def describe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, n_nodes, n_hard, n_soft, n_layers)."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    sizes = layers(nodes, edges).groupBy("graph").agg(F.count("*").alias("n_nodes"), (F.coalesce(F.max("layer"), F.lit(-1)) + 1).alias("n_layers"))
    kinds = edges.groupBy("graph").agg(count("hard").alias("n_hard"), count("soft").alias("n_soft"))
    return sizes.join(kinds, "graph", "left").na.fill(0, ["n_hard", "n_soft"]).select("graph", "n_nodes", "n_hard", "n_soft", "n_layers")
