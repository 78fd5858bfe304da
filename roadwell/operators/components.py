"""Strongly connected components: in one task where the graph is known to fit, else by colouring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwell.plans.nearest import spread, transpose
from roadwell.shipping import ship
from roadwell.storage import materialise


#: Nodes and arcs that one task may hold.
LOCAL = 2_000_000


def local_components(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, component) of a whole graph; a node of its own is an arc to itself.

    Two depth-first walks with stacks: one for the order in which nodes are left, one against the
    arcs in the reverse of that order.
    """
    ahead: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for a, b in zip(rows["src"].tolist(), rows["dst"].tolist()):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
        back.setdefault(b, []).append(a)
        back.setdefault(a, [])
    left, seen = [], set()
    for start in ahead:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead[start]))]
        while stack:
            node, rest = stack[-1]
            new = next((b for b in rest if b not in seen), None)
            if new is None:
                left.append(node)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(ahead[new])))
    name: dict[int, int] = {}
    for start in reversed(left):
        if start in name:
            continue
        members, stack = [], [start]
        name[start] = start
        while stack:
            node = stack.pop()
            members.append(node)
            for a in back[node]:
                if a not in name:
                    name[a] = start
                    stack.append(a)
        least = min(members)
        name.update(dict.fromkeys(members, least))
    return pd.DataFrame({"node": list(name), "component": list(name.values())})


def strong_components(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, component) with the component's lowest node as its name.

    Beyond LOCAL rows a round colours each node by the lowest node that reaches it.  Of a colour those that reach
    its name back are one component; the rest goes into the next round.
    """
    left = nodes.select(F.col("node").cast("long")).distinct()
    ways = arcs.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.lit(0).alias("w")).where("src <> dst").distinct()
    left, ways = materialise(left, "scc-nodes"), materialise(ways, "scc-arcs")
    if left.count() + ways.count() <= LOCAL:
        ship(left.sparkSession)
        whole = ways.select("src", "dst").unionByName(left.select(F.col("node").alias("src"), F.col("node").alias("dst")))
        found = whole.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(local_components, "node long, component long")
        return found.join(left, "node", "left_semi")
    done = None
    while True:
        left, ways = materialise(left, "scc-nodes"), materialise(ways, "scc-arcs")
        if left.isEmpty():
            return done if done is not None else left.withColumn("component", F.col("node"))
        start = left.select(F.lit(0).alias("scenario"), "node", F.col("node").alias("label"))
        colour = materialise(spread(ways, start, F.lit(0)).select("node", F.col("label").alias("colour")), "scc-colours")
        a = colour.select(F.col("node").alias("src"), F.col("colour").alias("_a"))
        b = colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b"))
        inside = materialise(ways.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst", "w"), "scc-inside")
        roots = colour.where("node = colour").select(F.lit(0).alias("scenario"), "node", F.col("node").alias("label"))
        found = spread(transpose(inside), roots, F.lit(0)).select("node", F.col("label").alias("component"))
        found = materialise(found, "scc-found")
        done = found if done is None else done.unionByName(found)
        left = left.join(found, "node", "left_anti")
        gone = found.select("node")
        ways = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")


def largest_component(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """Nodes of the largest strongly connected component; of equal ones that with the lowest node."""
    found = materialise(strong_components(nodes, arcs), "scc")
    best = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return found.join(best, "component", "left_semi").select("node")
