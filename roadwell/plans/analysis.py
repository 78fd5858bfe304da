"""Summaries of trials and of two metrics' answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadwell.functions.text import three_decimals

CELL = ["label", "alg", "k", "q", "B", "strategy", "p"]
SAME = ["label", "alg", "k", "q", "B"]
STRATEGIES = ("source", "graph", "scenario")


def measures(trials: DataFrame) -> DataFrame:
    """Measured trials (the first is a warm-up) with load balance and shares of waiting and transfer."""
    part = lambda c: F.try_divide(F.col(c), F.col("wall"))
    rows = trials.where("trial >= 1").withColumn("lb", F.try_divide(F.col("comp_max") - F.col("comp_min"), F.col("comp_mean")))
    rows = rows.withColumn("wait_frac", part("wait_mean")).withColumn("xfer_frac", part("xfer_mean"))
    return rows.withColumn("comm_frac", F.col("wait_frac") + F.col("xfer_frac"))


def summary(trials: DataFrame) -> DataFrame:
    """A row for each cell: medians, range, whether verified, and speedup against the sequential cell."""
    held = measures(trials).dropna(subset=CELL)
    middle = {"wall": "wall", "comp": "comp_mean", "wait": "wait_mean", "xfer": "xfer_mean", "lb": "lb", "comm_frac": "comm_frac",
              "wait_frac": "wait_frac", "xfer_frac": "xfer_frac", "msgs": "msgs", "steps": "steps", "edge_cut": "edge_cut"}
    cells = held.groupBy(*CELL).agg(
        *[F.percentile(c, F.lit(0.5)).alias(name) for name, c in middle.items()],
        F.min("wall").alias("wall_min"), F.max("wall").alias("wall_max"), F.count("*").alias("trials"),
        F.min_by("n", "trial").alias("n"), F.min_by("m", "trial").alias("m"),
    )
    checked = trials.where("trial = 0").groupBy(*CELL).agg(F.min("verified").alias("verified"))
    cells = cells.join(checked, CELL, "left")
    base = cells.where("strategy = 'seq'").select(*SAME, F.col("wall").alias("seq_wall"), F.col("wall_min").alias("seq_min"), F.col("wall_max").alias("seq_max"))
    cells = cells.join(base, SAME, "left")
    speed = lambda c: F.try_divide(F.col("seq_wall"), F.col(c))
    cells = cells.withColumn("speedup", speed("wall")).withColumn("speedup_lo", speed("wall_max")).withColumn("speedup_hi", speed("wall_min"))
    return cells.withColumn("efficiency", F.col("speedup") / F.col("p"))


def unverified(cells: DataFrame) -> DataFrame:
    """How many cells there are, and parallel ones whose first trial was not found equal."""
    return cells.agg(F.count("*").alias("cells"), F.count_if((F.col("strategy") != "seq") & ~F.col("verified").eqNullSafe(F.lit(1))).alias("unverified"))


def default_cells(cells: DataFrame, defaults: dict[str, dict]) -> DataFrame:
    """Each graph's cells at its own default k, q and B; defaults are those by graph."""
    spark = cells.sparkSession
    rows = [(g, d["k"], d["q"], d["B"]) for g, d in defaults.items()]
    chosen = spark.createDataFrame(rows, "label string, k int, q int, B int")
    return cells.join(chosen, ["label", "k", "q", "B"], "left_semi")


def in_table_order(cells: DataFrame) -> DataFrame:
    return cells.orderBy("label", "alg", "strategy", "p")


def speedup_rows(cells: DataFrame) -> DataFrame:
    """Speedup by p for each strategy, with its range, and the ideal line."""
    own = cells.where("strategy <> 'seq'").select("label", "alg", "strategy", "p", "speedup", "speedup_lo", "speedup_hi")
    ideal = own.select("label", "alg", "p").distinct()
    ideal = ideal.select("label", "alg", F.lit("ideal").alias("strategy"), "p", *[F.col("p").cast("double").alias(c) for c in ("speedup", "speedup_lo", "speedup_hi")])
    return own.unionByName(ideal)


def sweep_rows(cells: DataFrame, most: int, defaults: dict) -> DataFrame:
    """Speedups at p = most where one of k, q and B varies and the others are at their defaults."""
    out = None
    for name in ("k", "q", "B"):
        rows = cells.where((F.col("p") == most) & (F.col("strategy") != "seq"))
        for other in defaults.keys() - {name}:
            rows = rows.where(F.col(other) == defaults[other])
        rows = rows.select(F.lit(name).alias("varied"), F.col(name).alias("value"), "label", "alg", "strategy", "speedup", "speedup_lo", "speedup_hi")
        out = rows if out is None else out.unionByName(rows)
    return out


def breakdown(cells: DataFrame, most: int) -> DataFrame:
    """Compute, wait and transfer at p = most as stacked bars; a strategy without a cell has zeros."""
    groups = cells.select("label", "alg").distinct()
    grid = groups.select("*", F.explode(F.array(*map(F.lit, STRATEGIES))).alias("strategy"))
    own = cells.where(F.col("p") == most).select("label", "alg", "strategy", "comp", "wait", "xfer")
    rows = grid.join(own, ["label", "alg", "strategy"], "left")
    parts = F.array(*[F.struct(F.lit(k).alias("part_no"), F.lit(c).alias("part"), F.coalesce(c, F.lit(0.0)).alias("seconds")) for k, c in enumerate(("comp", "wait", "xfer"))])
    rows = rows.select("label", "alg", "strategy", F.explode(parts).alias("x")).select("label", "alg", "strategy", "x.*")
    below = Window.partitionBy("label", "alg", "strategy").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bottom", F.coalesce(F.sum("seconds").over(below), F.lit(0.0)))


def main_table(cells: DataFrame, most: int) -> DataFrame:
    """Median times at p = 1, 2 and most as text, '-' where there is none, with the figures at most."""
    own = cells.where("strategy <> 'seq'")
    keys = ["label", "alg", "strategy"]
    shown = [1, 2, most]
    times = own.groupBy(*keys).pivot("p", shown).agg(F.first(three_decimals(F.col("wall"))))
    times = times.select(*keys, *[F.coalesce(F.col(str(p)), F.lit("-")).alias(f"t_{name}") for p, name in zip(shown, ("1", "2", "top"))])
    top = own.where(F.col("p") == most).select(*keys, "speedup", "efficiency", "lb", "comm_frac")
    return times.join(top, keys)


def paired(dumps: DataFrame) -> DataFrame:
    """Both metrics' answers for each origin: (graph, k, qidx, node, idx_w, dist_w, idx_h, dist_h, m_per_hop)."""
    keys = ["graph", "k", "qidx", "node"]
    one = dumps.where("alg = 'dijkstra'").select(*keys, F.col("school_idx").alias("idx_w"), F.col("dist").alias("dist_w"))
    two = dumps.where("alg = 'bfs'").select(*keys, F.col("school_idx").alias("idx_h"), F.col("dist").alias("dist_h"))
    return one.join(two, keys).withColumn("m_per_hop", F.col("dist_w") / F.greatest(F.col("dist_h"), F.lit(1)))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of x and y in each group; values that tie share their mean rank.

    Ranks come from the counts of distinct values, which are combined before they are shuffled, so
    a group's window holds its distinct values and not its rows.
    """
    ranked = rows
    for c in (x, y):
        counts = rows.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        upto = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranks = counts.select(*keys, c, (F.sum("_n").over(upto) - (F.col("_n") - 1) / 2).alias(f"_rank_{c}"))
        ranked = ranked.join(ranks, [*keys, c])
    return ranked.groupBy(*keys).agg(F.corr(f"_rank_{x}", f"_rank_{y}").alias("spearman_dist_vs_hops"))


def differences(dumps: DataFrame) -> DataFrame:
    """How far shortest and fewest-hops answers differ, by graph and k."""
    keys = ["graph", "k"]
    both = paired(dumps)
    whole = both.groupBy(*keys).agg(
        F.count("*").alias("origins"), F.avg((F.col("idx_w") != F.col("idx_h")).cast("int")).alias("nearest_school_differs"),
        (F.avg("dist_w") / 1000).alias("mean_road_km"), F.avg("dist_h").alias("mean_hops"),
    )
    moved = both.where("dist_h > 0 AND dist_w > 0")
    share = moved.groupBy(*keys).agg(
        F.percentile("m_per_hop", F.lit(0.5)).alias("median_m_per_hop"), F.percentile("m_per_hop", F.lit(0.25)).alias("iqr_m_per_hop_lo"),
        F.percentile("m_per_hop", F.lit(0.75)).alias("iqr_m_per_hop_hi"),
    )
    return whole.join(share, keys, "left").join(spearman(moved, keys, "dist_w", "dist_h"), keys, "left")


def scatter(dumps: DataFrame, most: int = 4000) -> DataFrame:
    """Hops and kilometres of a fixed sample of at most ``most`` origins of the largest k."""
    both = paired(dumps)
    top = both.select("graph", "k").distinct().orderBy(F.desc("k"), "graph").limit(1)
    rows = both.join(top, ["graph", "k"], "left_semi")
    order = F.md5(F.col("qidx").cast("string").cast("binary"))
    return rows.orderBy(order, "qidx").limit(most).select("qidx", F.col("dist_h").alias("hops"), (F.col("dist_w") / 1000).alias("km"))
