"""Cycles of task graphs: who is on one, and a shortest one of each group of nodes that reach each other.

``nodes(graph, name, ...)`` and ``edges(graph, src, dst, ...)`` as in ``graphs``; edges of any kind count, and those
without both ends are left out. Nodes that nothing can come back to are trimmed first, along and against the edges;
cycles that nothing else touches are found while chains are contracted (``chains``), in as many rounds as their length
has bits. The rest is coloured: each chain takes the largest name that reaches it, and those that reach back to the chain
of that name are strongly connected with it; what isn't goes on to the next turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import chains
from sparkloom.operators.chains import KEY, dealt
from sparkloom.session import counted, gathered, scope, written


def _within(members: DataFrame, edges: DataFrame, *same: str) -> DataFrame:
    """Edges whose ends are both members, and alike in the columns ``same``."""
    ends = [members.select("graph", F.col("name").alias(side), *[F.col(c).alias(f"{side} {c}") for c in same]) for side in ("src", "dst")]
    both = edges.join(ends[0], ["graph", "src"]).join(ends[1], ["graph", "dst"])
    for c in same:
        both = both.where(F.col(f"src {c}") == F.col(f"dst {c}"))
    return both.select("graph", "src", "dst")


def _trimmed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are behind a cycle and before one (or on it), and the edges among them."""
    plain = nodes.select(*KEY, F.lit(0.0).alias("weight"), F.lit(False).alias("cut"))
    back = edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))
    behind, n = counted(chains.ordered(plain, edges.withColumn("pos", F.lit(0))).where("layer IS NULL").select(KEY), "behind")
    if not n:
        return behind, edges.limit(0)
    before = chains.ordered(plain, back.withColumn("pos", F.lit(0))).where("layer IS NULL").select(KEY)
    left = written(behind.join(before, KEY, "left_semi"), "cyclic")
    return left, written(_within(left, edges), "cyclic-edges")


def _coloured(heads: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, name, color): strongly connected groups of ``heads`` over ``links(graph, src, dst)``. Written."""
    with scope() as keep:
        heads, n = counted(heads.select(KEY), "heads")
        links, n_links = counted(links.distinct(), "links")
        part, groups = dealt(n, n_links), []
        none = written(heads.limit(0).withColumn("color", F.col("name")), "groups")
        while n:
            tables, changed = [written(part(heads).withColumn("color", F.col("name")), "colors")], 1
            while changed:  # the largest name that reaches a head
                front = part(tables[-1]).select("graph", F.col("name").alias("src"), "color")
                sent = part(links).join(front, ["graph", "src"]).groupBy("graph", F.col("dst").alias("name")).agg(F.max("color").alias("color"))
                known = part(gathered(tables)).groupBy(KEY).agg(F.max("color").alias("known"))
                more, changed = counted(sent.join(known, KEY).where("color > known").select(*KEY, "color"), "colors")
                tables.append(more)
            colors = written(part(gathered(tables)).groupBy(KEY).agg(F.max("color").alias("color")), "colors")
            own = written(_within(part(colors), part(links), "color"), "own-links")
            front, found, more = part(colors).where("name = color"), [], 1
            while more:  # those of a colour that reach back to it
                back, more = counted(front if not found else front.join(part(gathered(found)), KEY, "left_anti").select(*KEY, "color"), "groups")
                found.append(back)
                to = part(back).select("graph", F.col("name").alias("dst"), "color")
                front = part(own).join(to, ["graph", "dst"]).select("graph", F.col("src").alias("name"), "color").distinct()
            groups += found
            heads, n = counted(part(heads).join(part(gathered(found)), KEY, "left_anti"), "heads")
            links = written(_within(part(heads), part(links)), "links") if n else links
        return keep(written(gathered(groups) if groups else none, "coloured"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, name, component) of the nodes on cycles: strongly connected ones have one component, its smallest name.

    A node that needs itself is a component; one that merely lies between two cycles isn't on one. Written.
    """
    with scope() as keep:
        nodes = written(nodes.select(KEY).distinct(), "nodes")
        edges = written(_within(nodes, edges).distinct(), "edges")
        nodes, edges = _trimmed(nodes, edges)
        placed, arcs, part = chains.walk(nodes.withColumns({"weight": F.lit(0.0), "cut": F.lit(False)}), edges.withColumn("pos", F.lit(0)))
        links = part(arcs).where("via IS NOT NULL").select("graph", F.col("via").alias("src"), "dst")
        groups = _coloured(part(placed).where("place = 0 AND ring IS NULL"), links)
        several = groups.groupBy("graph", "color").agg(F.count("*").alias("n")).where("n > 1").select("graph", "color")
        alone = links.where("src = dst").select("graph", F.col("src").alias("color"))
        real = groups.join(several.union(alone).distinct(), ["graph", "color"], "left_semi").select("graph", F.col("name").alias("head"), "color")
        inside = part(placed).join(real, ["graph", "head"]).select(*KEY, "color")
        lowest = inside.groupBy("graph", "color").agg(F.min("name").alias("component"))
        rings = part(placed).where("ring IS NOT NULL").select(*KEY, F.col("ring").alias("component"))
        return keep(written(rings.union(inside.join(lowest, ["graph", "color"]).select(*KEY, "component")), "components"))


def shortest_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, component, members, length, path): of each component a shortest cycle through its smallest name.

    The path begins and ends there; of needs that are as near, the first by name is taken. Two components never meet.
    """
    with scope() as keep:
        members = components(nodes, edges)
        sizes = members.groupBy("graph", "component").agg(F.count("*").alias("members"))
        inner = written(_within(members, edges, "component").distinct(), "inner")
        start = members.select(*KEY, F.lit(0.0).alias("weight"), (F.col("name") == F.col("component")).alias("start"), F.lit(False).alias("closed"), "component")
        made = chains.nearest(start, inner.withColumn("pos", F.lit(0)))
        back = inner.join(made.select("graph", F.col("name").alias("src"), "dist", "component"), ["graph", "src"]).where("dst = component")
        closing = back.groupBy("graph", "component").agg(F.min(F.struct("dist", "src")).alias("last"))
        closing = written(closing.select("graph", "component", (F.col("last.dist") + 1).cast("int").alias("length"), F.col("last.src").alias("end")), "closing")
        paths = chains.in_order(chains.ways(made, closing.select("graph", "end")), ["graph", "end"])
        whole = closing.join(sizes, ["graph", "component"]).join(paths, ["graph", "end"])
        return keep(written(whole.select("graph", "component", "members", "length", F.concat("path", F.array("component")).alias("path")), "cycles"))
