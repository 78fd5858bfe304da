"""A connected road-like grid: a random spanning tree and some more edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwell.functions.rng import below, stream

#: Weights are LEAST to LEAST + SPAN - 1; of edges off the tree KEPT in a hundred stay (fixed values).
LEAST, SPAN, KEPT = 30, 271, 40


def grid_size(target: int) -> tuple[int, int]:
    """Width and height of the grid that holds at least target nodes."""
    wide = math.isqrt(target - 1) + 1 if target > 0 else 0
    return wide, -(-target // wide) if wide else 0


def pool_size(target: int) -> tuple[int, int]:
    """Nodes of the grid for target nodes, and facilities of its pool: a twentieth of them, 50 at least."""
    wide, high = grid_size(target)
    return wide * high, max(wide * high // 20, 50)


def grid_candidates(spark: SparkSession, target: int, seed: int) -> DataFrame:
    """(idx, a, b, w): each node's edge to the right and then down, row by row, with drawn weights.

    idx is the edge's place, in closed form, so weights are made in parallel.
    """
    wide, high = grid_size(target)
    cells = spark.range(wide * high).select(F.col("id").alias("v"), F.floor(F.col("id") / wide).alias("y"), (F.col("id") % wide).alias("x"))
    # rows before y hold 2 * wide - 1 edges each; the last row has none down
    before = F.col("y") * (2 * wide - 1) + F.when(F.col("y") < high - 1, 2 * F.col("x")).otherwise(F.col("x"))
    right = F.when(F.col("x") < wide - 1, F.struct(before.alias("idx"), F.col("v").alias("a"), (F.col("v") + 1).alias("b")))
    down = F.when(F.col("y") < high - 1, F.struct((before + F.when(F.col("x") < wide - 1, 1).otherwise(0)).alias("idx"), F.col("v").alias("a"), (F.col("v") + wide).alias("b")))
    edges = cells.select(F.explode(F.array_compact(F.array(right, down))).alias("e")).select("e.*")
    return edges.withColumn("w", LEAST + below(seed, F.col("idx"), SPAN))


def synthetic_graph(spark: SparkSession, target: int, seed: int) -> DataFrame:
    """(src, dst, w), both ways of each kept edge.

    The shuffle of the edges and the tree's growth take their draws one after another, so they run
    in one place; the weights' draws come first and are skipped there.
    """
    wide, high = grid_size(target)
    edges = [(v, v + step, k) for v in range(wide * high) for k, (step, ok) in enumerate(((1, v % wide + 1 < wide), (wide, v // wide + 1 < high))) if ok]
    draws = stream(seed)
    kept = [(a, b, LEAST + next(draws) % SPAN) for a, b, _ in edges]
    for i in range(len(kept), 1, -1):
        j = next(draws) % i
        kept[i - 1], kept[j] = kept[j], kept[i - 1]
    root = list(range(wide * high))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = []
    for a, b, w in kept:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
        elif next(draws) % 100 >= KEPT:
            continue
        rows.append((a, b, w))
    one = spark.createDataFrame(rows, "src long, dst long, w long")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
