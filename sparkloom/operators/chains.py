"""Chains of a graph, contracted: what makes walks along edges take few rounds over deep graphs.

``nodes(graph, name, weight, cut)`` has unique rows; ``needs(graph, src, dst, pos)`` are edges. An edge is inside a chain
if it is the only one out of its source and the only one into its target, and the target isn't ``cut``. Pointers along
such edges are doubled until each node knows its chain's head, so a chain of n nodes takes log2(n) rounds; walks then go
from chain to chain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import counted, gathered, scope, written

KEY = ["graph", "name"]
SMALL = 100_000  # rows that one task takes without a shuffle
TURNS = 1  # rounds in one plan


def dealt(*sizes: int) -> Callable[[DataFrame], DataFrame]:
    """What puts a table into one part, if all that meet are small together: rounds over them then need no shuffle."""
    return (lambda df: df.coalesce(1)) if sum(sizes) <= SMALL else (lambda df: df)


class Walk(NamedTuple):
    """Nodes in their chains, the edges between chains, and how tables of this size are dealt."""

    placed: DataFrame
    arcs: DataFrame
    part: Callable[[DataFrame], DataFrame]


def _doubled(jumps: DataFrame) -> DataFrame:
    """Pointers that don't yet point at a head, moved on by where they point."""
    nexts = jumps.select("graph", F.col("name").alias("to"), *[F.col(c).alias(f"next_{c}") for c in ("to", "place", "ahead", "low", "done")])
    sums = [(F.col(c) + F.col(f"next_{c}")).alias(c) for c in ("place", "ahead")]
    moved = jumps.where("NOT done").join(nexts, ["graph", "to"])
    moved = moved.select(*KEY, "src", F.col("next_to").alias("to"), *sums, F.least("low", "next_low").alias("low"), F.col("next_done").alias("done"))
    return jumps.where("done").unionByName(moved)


def chained(nodes: DataFrame, needs: DataFrame, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add to ``nodes``: the ``head`` of its chain, its ``place`` behind it, the weight ``ahead`` (of the nodes after the head up to
    itself), ``before`` (its only need, inside a chain) and ``ring`` (the smallest name of a cycle that nothing else touches, or null).
    A node that no chain holds is its own head; those of a ring are too. Written."""
    with scope() as keep:
        into = part(needs).groupBy("graph", F.col("dst").alias("name")).agg(F.count("*").alias("n"), F.first("src").alias("src")).where("n = 1").drop("n")
        out = part(needs).groupBy("graph", "src").agg(F.count("*").alias("n")).where("n = 1").drop("n")
        known = part(nodes).select("graph", F.col("name").alias("src"))
        links = part(nodes).where("NOT cut").select(*KEY, "weight").join(into, KEY).join(out, ["graph", "src"], "left_semi").join(known, ["graph", "src"], "left_semi")
        links, n = counted(links, "links")
        inner = part(links).select("graph", F.col("name").alias("src"), F.lit(True).alias("inner"))
        start = part(links).join(inner, ["graph", "src"], "left")
        smaller = F.least(F.col("name"), F.col("src"))
        jumps = start.select(*KEY, "src", F.col("src").alias("to"), F.lit(1).cast("long").alias("place"), F.col("weight").alias("ahead"), smaller.alias("low"), F.col("inner").isNull().alias("done"))
        span, open_ = 1, n
        while span <= n and open_:
            made, open_ = counted(_doubled(_doubled(jumps)), "jumps", F.expr("NOT done"))
            span, jumps = 4 * span, part(made)
        none = F.lit(None).cast(nodes.schema["name"].dataType)
        found = jumps.select(*KEY, "src", F.when(F.col("done"), F.col("to")).otherwise(F.col("name")).alias("to"), *[F.when(F.col("done"), F.col(c)).otherwise(0).alias(c) for c in ("place", "ahead")], F.when(F.col("done"), none).otherwise(F.col("low")).alias("ring"))
        made = part(nodes).join(found, KEY, "left")
        before = F.when(F.col("place") > 0, F.col("src")).alias("before")
        rest = [F.coalesce("to", "name").alias("head"), F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("ahead", F.lit(0.0)).alias("ahead"), before, "ring"]
        return keep(written(made.select(*nodes.columns, *rest), "chained"))


def walk(nodes: DataFrame, needs: DataFrame) -> Walk:
    """Write both tables, put nodes in their chains, and give the edges between those.

    Arcs are (graph, via, dst, pos, src, place, ahead, weight, n_in): the edges into heads, with the chain ``via`` that they come
    from, null if the source isn't a node; ``n_in`` counts all edges into ``dst``.
    """
    with scope() as keep:
        needs, n_needs = counted(needs, "needs")
        nodes, n_nodes = counted(nodes, "nodes")
        part = dealt(n_needs, n_nodes)
        placed = keep(chained(nodes, needs, part))
        heads = part(placed).where("place = 0").select("graph", F.col("name").alias("dst"), "weight")
        into = part(needs).join(heads, ["graph", "dst"])
        degree = into.groupBy("graph", "dst").agg(F.count("*").alias("n_in"))
        tails = part(placed).select("graph", F.col("name").alias("src"), F.col("head").alias("via"), "place", "ahead")
        made = into.join(degree, ["graph", "dst"]).join(tails, ["graph", "src"], "left")
        made = made.select("graph", "via", "dst", F.col("pos").cast("int").alias("pos"), "src", "place", "ahead", "weight", "n_in")
        return Walk(placed, keep(written(made, "arcs")), part)


def ordered(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """``chained`` with ``layer``, ``total`` and ``before`` of each node's heaviest way; all null on or behind a cycle. Written.

    A head is ready when all edges into it have come; it then sends its layer and total to the chains behind it. Of needs
    that tie the one listed last counts. A table holds what became ready in its rounds and what waits for more: nodes that
    no message has reached yet aren't touched.
    """
    with scope() as keep:
        placed, arcs, part = walk(nodes, needs)
        none = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("pos"), F.lit(None).cast(nodes.schema["name"].dataType).alias("src"))
        zero = F.lit(0).cast("long")
        free = part(placed).where("place = 0").join(part(arcs).select("graph", F.col("dst").alias("name")), KEY, "left_anti")
        held = free.select(*KEY, "weight", zero.alias("met"), zero.alias("n_in"), zero.alias("layer"), none.alias("best"))
        tables, shown = [], [held]
        while True:
            for _ in range(TURNS):
                sent_by = held.where("met = n_in").select("graph", F.col("name").alias("via"), "layer", (F.col("best.total") + F.col("weight")).alias("total"))
                best = F.struct((F.col("total") + F.col("ahead")).alias("total"), "pos", "src").alias("best")
                sent = part(arcs).join(sent_by, ["graph", "via"]).select("graph", F.col("dst").alias("name"), "weight", F.lit(1).cast("long").alias("met"), "n_in", (F.col("layer") + F.col("place") + 1).alias("layer"), best)
                merged = held.where("met < n_in").unionByName(sent).groupBy(*KEY, "weight", "n_in")
                held = merged.agg(F.sum("met").alias("met"), F.max("layer").alias("layer"), F.max("best").alias("best"))
                shown.append(held)
            made = shown.pop().withColumn("fresh", F.lit(True))
            for past in shown:  # what became ready on the way
                made = made.unionByName(past.where("met = n_in").withColumn("fresh", F.lit(False)), allowMissingColumns=True)
            made, n_ready = counted(made, "ready", F.expr("met = n_in AND fresh"))
            tables.append(made)
            if not n_ready:
                break
            held, shown = part(made).where("fresh").drop("fresh"), []
        ready = part(gathered(tables)).where("met = n_in").select("graph", F.col("name").alias("head"), F.col("layer").alias("head_layer"), (F.col("best.total") + F.col("weight")).alias("head_total"), F.col("best.src").alias("head_before"))
        whole = part(placed).join(ready, ["graph", "head"], "left")
        made = whole.select(
            *KEY, "weight", "head", "place", (F.col("head_layer") + F.col("place")).cast("int").alias("layer"), (F.col("head_total") + F.col("ahead")).alias("total"),
            F.when(F.col("place") > 0, F.col("before")).otherwise(F.col("head_before")).alias("before"),
        )
        return keep(written(made, "ordered"))


def nearest(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """``chained`` with ``dist``, the number of edges from the nearest start, and ``before``, the first need by name that is nearer. Written.

    ``nodes`` has ``start`` and ``closed`` besides; a closed node isn't entered. Starts and closed nodes are cut here. Null
    where nothing leads. A round follows what the round before it has brought nearer, and nothing else.
    """
    with scope() as keep:
        placed, arcs, part = walk(nodes.withColumn("cut", F.col("start") | F.col("closed")), needs)
        open_ = part(placed).where("place = 0 AND NOT start AND NOT closed").select(KEY)
        starts = part(placed).where("start").select(*KEY, F.lit(0).cast("long").alias("dist"))
        tables, front, n = [], starts, 1
        while n:
            reached = []
            for _ in range(TURNS):
                via = front.select("graph", F.col("name").alias("via"), "dist")
                sent = part(arcs).join(via, ["graph", "via"]).groupBy("graph", F.col("dst").alias("name")).agg(F.min(F.col("dist") + F.col("place") + 1).alias("dist"))
                front = sent.join(open_, KEY, "left_semi")
                reached.append(front)
            made = reduce(DataFrame.union, reached).groupBy(KEY).agg(F.min("dist").alias("dist"))
            if tables:
                known = part(gathered(tables)).groupBy(KEY).agg(F.min("dist").alias("known"))
                made = made.join(known, KEY, "left").where("known IS NULL OR dist < known").select(*KEY, "dist")
            made, n = counted(made, "near")
            tables.append(made)
            front = part(made)
        best = part(gathered(tables)).union(starts).groupBy("graph", F.col("name").alias("head")).agg(F.min("dist").alias("dist"))
        far = part(placed).join(best, ["graph", "head"], "left").withColumn("dist", F.col("dist") + F.col("place"))
        far = written(far, "distances")
        at = part(far).where("dist IS NOT NULL")
        last = part(arcs).select("graph", "src", F.col("dst").alias("name")).join(at.where("place = 0 AND dist > 0").select(*KEY, F.col("dist").alias("mine")), KEY)
        last = last.join(at.select("graph", F.col("name").alias("src"), "dist"), ["graph", "src"]).where("dist + 1 = mine").groupBy(KEY).agg(F.min("src").alias("nearer"))
        made = part(far).join(last, KEY, "left").withColumn("before", F.when(F.col("dist").isNotNull(), F.coalesce("before", "nearer"))).drop("nearer")
        return keep(written(made, "nearest"))


def ways(made: DataFrame, ends: DataFrame) -> DataFrame:
    """(graph, end, name, step, place): the nodes of the way that leads to each of ``ends(graph, end)``, along ``before``.

    ``made`` is what ``ordered`` or ``nearest`` returned. In order are falling steps (chains, counted from the end), then
    rising places. Jumps from chain to chain are doubled, and the longest are taken first: a way over n chains takes
    log2(n) rounds, and no row holds more than one node.
    """
    with scope() as keep:
        homes = made.select("graph", F.col("name").alias("before"), F.col("head").alias("to"))
        first, n = counted(made.where("place = 0").select("graph", F.col("name").alias("head"), "before").join(homes, ["graph", "before"]).select("graph", "head", "to"), "jumps")
        part, jumps, held = dealt(n), [], first
        twice = lambda df: df.join(df.select("graph", F.col("head").alias("to"), F.col("to").alias("next")), ["graph", "to"]).select("graph", "head", F.col("next").alias("to"))
        while n:
            jumps += [part(held), twice(part(held))]
            held, n = counted(twice(jumps[-1]), "jumps")
        ends = ends.select("graph", "end").distinct()
        found = ends.join(made.select("graph", F.col("name").alias("end"), "head", F.col("place").alias("upto")), ["graph", "end"]).withColumn("step", F.lit(0).cast("long"))
        for k in range(len(jumps) - 1, -1, -1):
            back = found.join(jumps[k], ["graph", "head"])
            back = back.select("graph", F.col("to").alias("head"), "end", F.lit(None).cast("long").alias("upto"), (F.col("step") + (1 << k)).alias("step"))
            found = found.select(back.columns).union(back)
            if k % 2 == 0:
                found = written(found, "steps")
        rows = found.join(made.select("graph", "head", "name", "place"), ["graph", "head"]).where("upto IS NULL OR place <= upto")
        return keep(written(rows.select("graph", "end", "name", "step", "place"), "ways"))


def in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, path): the rows of ``ways`` as an array for each of ``by``; for reading, or for short ways."""
    nodes = F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("step"), "place", "name")))
    return rows.groupBy(*by).agg(nodes.alias("path")).select(*by, F.col("path.name").alias("path"))
