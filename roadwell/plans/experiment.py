"""The matrix of an experiment's cells, what of it is still to do, and its dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["label", "alg", "strategy", "p", "k", "q", "B"]


def graph_spec(spark: SparkSession, graphs: dict[str, tuple[int, int]], quick: bool = False) -> DataFrame:
    """(label, n, pool, k, q, B): the default workload of each graph (n nodes, pool facilities)."""
    rows = spark.createDataFrame([(g, n, pool) for g, (n, pool) in graphs.items()], "label string, n long, pool long")
    k = F.greatest(F.lit(1), F.floor(F.col("pool") / 4))
    q = F.greatest(F.lit(1), F.least(F.lit(1000 if quick else 5000), F.floor(F.col("n") / 5)))
    return rows.select("*", k.cast("int").alias("k"), q.cast("int").alias("q"), F.lit(4 if quick else 8).alias("B"))


def process_counts(most: int) -> list[int]:
    powers = [p for p in (1, 2, 4, 8) if p <= most]
    return powers if most in powers else [*powers, most]


def matrix(spark: SparkSession, graphs: dict[str, tuple[int, int]], most: int = 4, quick: bool = False) -> DataFrame:
    """All parallel cells once: each graph's defaults, and on the medium graph sweeps over k, q and B."""
    spec = graph_spec(spark, graphs, quick)
    if quick:
        loads = spec.where("label = 'small'").select("label", "k", "q", "B")
    else:
        middle = spec.where("label = 'medium'")
        shares = F.array(*[F.floor(F.col("pool") / d) for d in (16, 8, 4, 2, 1)])
        by_k = middle.select("label", F.explode(shares.cast("array<int>")).alias("k"), "q", "B")
        by_q = middle.select("label", "k", F.explode(F.array(*[F.least(F.lit(v), F.floor(F.col("n") / 2)) for v in (100, 1000, 10000, 50000)]).cast("array<int>")).alias("q"), "B")
        by_b = middle.select("label", "k", "q", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))).alias("B"))
        loads = spec.select("label", "k", "q", "B").unionByName(by_k.where("k >= 1")).unionByName(by_q.where("q >= 1")).unionByName(by_b)
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    cells = loads.distinct().select("*", each(("dijkstra", "bfs"), "alg")).select("*", each(("source", "graph", "scenario"), "strategy"))
    return cells.select("*", each(process_counts(most), "p")).select(*CELL)


def baselines(cells: DataFrame) -> DataFrame:
    """The sequential cell that each parallel one is compared with."""
    return cells.select("label", "alg", F.lit("seq").alias("strategy"), F.lit(1).alias("p"), "k", "q", "B").distinct()


def todo(cells: DataFrame, trials: DataFrame) -> DataFrame:
    """Cells with no trial row yet."""
    return cells.join(trials.select(*CELL).distinct(), CELL, "left_anti")


def dump_jobs(spark: SparkSession, graphs: dict[str, tuple[int, int]], quick: bool = False) -> DataFrame:
    """(label, alg, k, q, B) of the runs whose answers are dumped."""
    spec = graph_spec(spark, graphs, quick)
    if quick:
        spec = spec.where("label = 'small'")
    more = F.when(F.col("label") == "medium", F.array(*[F.floor(F.col("pool") / d).cast("int") for d in (16, 4, 1)])).otherwise(F.expr("cast(array() as array<int>)"))
    ks = F.filter(F.array_distinct(F.concat(F.array("k"), more)), lambda k: k >= 1)
    q = F.least(F.lit(20000), F.floor(F.col("n") / 2)).cast("int")
    rows = spec.select("label", F.explode(ks).alias("k"), q.alias("q"), F.lit(1).alias("B"))
    return rows.select("label", F.explode(F.array(F.lit("dijkstra"), F.lit("bfs"))).alias("alg"), "k", "q", "B")
