"""Registered queries of the road-graph operators and the SQL that states their results.

The driver's tables hold no roads.  An order is joined to its parts by line number and a part to
its suppliers by quantity, which makes a weighted graph with suppliers as facilities; embeddings
give coordinates; an order's lines are a way; and lines stand in for trial rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwell.storage import materialise, table, views

PART, ORDER = 1_000_000, 10_000_000

# ---------------------------------------------------------------------------------------------
# The supply graph

PAIRS_SQL = f"""
SELECT l_suppkey AS a, {PART} + l_partkey AS b, min(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY l_suppkey, l_partkey
UNION ALL
SELECT {PART} + l_partkey AS a, {ORDER} + l_orderkey AS b, min(CAST(l_linenumber AS BIGINT)) AS w FROM lineitem GROUP BY l_partkey, l_orderkey
"""
ARCS_SQL = "SELECT a AS src, b AS dst, w FROM pairs UNION ALL SELECT b AS src, a AS dst, w FROM pairs"


def supply_arcs(spark: SparkSession, sf_dir: str, both_ways: bool = True) -> DataFrame:
    """Arcs of the search graph, away from suppliers and, unless told, back."""
    lines = table(spark, sf_dir, "lineitem")
    part, order = F.col("l_partkey") + PART, F.col("l_orderkey") + ORDER
    first = lines.groupBy(F.col("l_suppkey").alias("src"), part.alias("dst")).agg(F.min(F.col("l_quantity").cast("long")).alias("w"))
    second = lines.groupBy(part.alias("src"), order.alias("dst")).agg(F.min(F.col("l_linenumber").cast("long")).alias("w"))
    arcs = first.unionByName(second)
    if not both_ways:
        return arcs
    # both ways from one reading of the sums
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "w")
    return arcs.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pool_idx"), F.col("s_suppkey").alias("node"))


def one_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers."""
    return table(spark, sf_dir, "supplier").select(F.lit(0).alias("scenario"), F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("pool_idx"))


def four_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return rows.select((F.col("s_suppkey") % 4).cast("int").alias("scenario"), F.floor(F.col("s_suppkey") / 4).alias("pos"), F.col("s_suppkey").alias("pool_idx"))


def order_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qidx"), (F.col("o_orderkey") + ORDER).alias("node"))


def supply_answers(scenarios, metric: str, strategy: str = "graph", both_ways: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from roadwell.plans.nearest import nearest_facility

        return nearest_facility(
            supply_arcs(spark, sf_dir, both_ways), suppliers(spark, sf_dir), scenarios(spark, sf_dir), order_origins(spark, sf_dir), metric, strategy
        )

    return query


ONE = "SELECT 0 AS s, s_suppkey AS v, min(s_suppkey) AS l FROM supplier GROUP BY s_suppkey"
FOUR = "SELECT CAST(s_suppkey % 4 AS INTEGER) AS s, s_suppkey AS v, min(s_suppkey) AS l FROM supplier GROUP BY s_suppkey"


def search_sql(seeds: str, metric: str, final: str, arcs: str = ARCS_SQL) -> str:
    """DuckDB SQL that finds lab(s, v, l), the least packed labels, and then selects from it."""
    step = "w" if metric == "weighted" else "1"
    return f"""
WITH RECURSIVE pairs AS MATERIALIZED ({PAIRS_SQL}),
arcs AS MATERIALIZED (SELECT src, dst, CAST(min({step}) AS BIGINT) * 4294967296 AS c FROM ({arcs}) GROUP BY src, dst),
lab(s, v, l) USING KEY (s, v) AS (
  SELECT * FROM ({seeds})
  UNION
  SELECT x.s, e.dst, min(x.l + e.c) FROM lab x JOIN arcs e ON e.src = x.v
  LEFT JOIN recurring.lab r ON r.s = x.s AND r.v = e.dst
  WHERE r.v IS NULL OR x.l + e.c < r.l GROUP BY x.s, e.dst),
grid AS (SELECT s, o_orderkey AS qidx, {ORDER} + o_orderkey AS node FROM orders CROSS JOIN (SELECT DISTINCT s FROM ({seeds}))),
answers AS (
  SELECT CAST(grid.s AS INTEGER) AS scenario, qidx, node, l % 4294967296 AS pool_idx, l // 4294967296 AS dist
  FROM grid LEFT JOIN lab ON lab.s = grid.s AND lab.v = grid.node)
{final}"""


ANSWERS = "SELECT scenario, qidx, node, pool_idx, dist FROM answers"


def colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facilities on each second supplier's node, numbered downwards: the lower number wins."""
    from roadwell.plans.nearest import nearest_facility

    rows = table(spark, sf_dir, "supplier")
    pool = rows.select((100000 - F.col("s_suppkey")).alias("pool_idx"), (F.col("s_suppkey") - F.col("s_suppkey") % 2 + 1).alias("node"))
    scenario = pool.select(F.lit(0).alias("scenario"), F.col("pool_idx").alias("pos"), "pool_idx")
    return nearest_facility(supply_arcs(spark, sf_dir), pool, scenario, order_origins(spark, sf_dir), "weighted")


COLOCATED = "SELECT 0 AS s, s_suppkey - s_suppkey % 2 + 1 AS v, min(100000 - s_suppkey) AS l FROM supplier GROUP BY 2"


def verify_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.verify import mismatches
    from roadwell.plans.nearest import Roads, arc_cost, nearest_facility

    roads = Roads(supply_arcs(spark, sf_dir), arc_cost("weighted"))
    pool, scenarios, origins = suppliers(spark, sf_dir), four_scenarios(spark, sf_dir), order_origins(spark, sf_dir)
    want, got = (nearest_facility(None, pool, scenarios, origins, "weighted", strategy, roads=roads) for strategy in ("seq", "source"))
    roads.close()
    return mismatches(want, got)


def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from roadwell.operators.verify import unplaced

    found = supply_answers(four_scenarios, "hops")(spark, sf_dir)
    n = table(spark, sf_dir, "orders").count()
    numbered = found.withColumn("qidx", F.row_number().over(Window.partitionBy("scenario").orderBy("qidx")) - 1)
    return unplaced(numbered, 4, n)


def origin_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.sources.tables import dump

    return dump(supply_answers(four_scenarios, "weighted", both_ways=False)(spark, sf_dir))


def all_labels(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    from roadwell.plans.nearest import arc_cost, seeds, spread

    start = seeds(four_scenarios(spark, sf_dir), suppliers(spark, sf_dir))
    return spread(supply_arcs(spark, sf_dir), start, arc_cost(metric))


def bfs_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = F.shiftright("label", 32).alias("hops")
    return all_labels(spark, sf_dir, "hops").select("scenario", hops).groupBy("scenario", "hops").agg(F.count("*").alias("nodes"))


def bfs_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supersteps of a sequential search by hops: levels of each scenario, the last included."""
    from roadwell.plans.trials import levels

    return levels(all_labels(spark, sf_dir, "hops")).agg(F.sum("levels").alias("steps"))


# ---------------------------------------------------------------------------------------------
# Compressed rows and partitions: the supply graph with nodes renumbered from 0 in their order

DENSE_SQL = f"""
pairs AS MATERIALIZED ({PAIRS_SQL}), arcs AS MATERIALIZED ({ARCS_SQL}),
ids AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT DISTINCT src AS node FROM arcs)),
dense AS MATERIALIZED (SELECT x.id AS src, y.id AS dst, w FROM arcs JOIN ids x ON x.node = arcs.src JOIN ids y ON y.node = arcs.dst),
deg AS MATERIALIZED (
  SELECT id AS node, CAST(n AS BIGINT) AS degree, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS xadj
  FROM (SELECT id, count(dense.src) AS n FROM ids LEFT JOIN dense ON dense.src = ids.id GROUP BY id))"""
BOUNDS_SQL = DENSE_SQL + """,
bounds AS MATERIALIZED (
  SELECT r, (SELECT coalesce(min(node), (SELECT count(*) FROM ids)) FROM deg WHERE xadj >= (SELECT count(*) FROM dense) * r // 4) AS first
  FROM range(1, 4) t(r))"""


def dense_graph(spark: SparkSession, sf_dir: str) -> tuple[int, int, DataFrame]:
    from roadwell.functions.geo import numbered
    from roadwell.operators.ways import renumber

    arcs = materialise(supply_arcs(spark, sf_dir), "supply")
    ids = materialise(numbered(arcs.select(F.col("src").alias("node")).distinct(), ["node"], "rank"), "supply-ids")
    dense = materialise(renumber(arcs, ids), "supply-dense")
    return ids.count(), dense.count(), dense


def degree_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.partition import degrees

    n, _, arcs = dense_graph(spark, sf_dir)
    return degrees(n, arcs)


def csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.partition import csr_rows

    n, _, arcs = dense_graph(spark, sf_dir)
    rows = csr_rows(n, arcs)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("node", "degree", "xadj", joined("adj"), joined("w"))


def with_bounds(spark: SparkSession, sf_dir: str):
    from roadwell.operators.partition import bounds, degrees

    n, m, arcs = dense_graph(spark, sf_dir)
    return n, arcs, bounds(degrees(n, arcs), n, m, 4)


def partition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, bound = with_bounds(spark, sf_dir)
    return spark.createDataFrame(list(zip(range(1, 4), bound[1:-1])), "r long, first long")


def owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.partition import owner

    n, _, bound = with_bounds(spark, sf_dir)
    return spark.range(n).select(F.col("id").alias("node"), owner(F.col("id"), bound).alias("part"))


def edge_cut_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.partition import edge_cut

    _, arcs, bound = with_bounds(spark, sf_dir)
    return edge_cut(arcs, bound).select(F.round("edge_cut", 9).alias("edge_cut"))


# ---------------------------------------------------------------------------------------------
# Random draws and synthetic grids


def splitmix_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.functions.rng import below, next_long

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    return rows.select("i", next_long(42, F.col("i")).alias("bits"), below(42, F.col("i"), 271).alias("below_271"))


SPLITMIX_STEPS = """
s0 AS (SELECT *, ((CAST({seed} AS UHUGEINT) + CAST({i} + 1 AS UHUGEINT) * CAST(11400714819323198485 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))::UBIGINT AS z0 FROM {src}),
s1 AS (SELECT *, ((xor(z0, z0 >> 30))::UHUGEINT * CAST(13787848793156543929 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT))::UBIGINT AS z1 FROM s0),
s2 AS (SELECT *, ((xor(z1, z1 >> 27))::UHUGEINT * CAST(10723151780598845931 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT))::UBIGINT AS z2 FROM s1),
s3 AS (SELECT *, xor(z2, z2 >> 31) AS z FROM s2)"""



def draws_sql(seeds: str, n: int, k: int, final: str) -> str:
    """DuckDB SQL that shuffles the first k of n places for each row of seeds (s, seed), and then selects from drawn(s, i, v)."""
    src = f"(SELECT s, seed, range AS i FROM {seeds} CROSS JOIN range({k}))"
    return f"""
WITH RECURSIVE {SPLITMIX_STEPS.format(seed="seed", i="i", src=src)},
picks AS MATERIALIZED (SELECT s, CAST(i AS BIGINT) AS i, CAST(i + z % CAST({n} - i AS UBIGINT) AS BIGINT) AS j FROM s3),
moves(s, i, perm) USING KEY (s) AS (
  SELECT s, CAST(0 AS BIGINT), range({n}) FROM {seeds}
  UNION
  SELECT m.s, m.i + 1, CASE WHEN p.j = p.i THEN perm ELSE
      perm[1:p.i] || [perm[p.j + 1]] || perm[p.i + 2:p.j] || [perm[p.i + 1]] || perm[p.j + 2:] END
  FROM moves m JOIN picks p ON p.s = m.s AND p.i = m.i),
drawn AS (SELECT s, range AS i, perm[range + 1] AS v FROM moves CROSS JOIN range({k}))
{final}"""


GRID_TARGET = 5000


def grid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.sources.synthetic import grid_candidates as make

    return make(spark, GRID_TARGET, 42)


def synth_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.sources.synthetic import synthetic_graph

    return synthetic_graph(spark, GRID_TARGET, 42)


def workload(spark: SparkSession, sf_dir: str):
    from roadwell.plans.workload import Workload

    return Workload(n=5041, pool=252, k=63, q=1008, B=8)


def query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload(spark, sf_dir).origins(spark)


def scenario_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload(spark, sf_dir).scenarios(spark)


def synth_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.workload import synthetic_pool

    return synthetic_pool(spark, 5041)


# ---------------------------------------------------------------------------------------------
# Ways: an order is a way and its lines are its nodes

WAY_NODES_SQL = """
SELECT l_orderkey AS way,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS pos,
  l_suppkey AS node,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_partkey % 360 AS DOUBLE) END AS lon,
  CAST(l_quantity AS DOUBLE) AS lat
FROM lineitem"""
WAYS_SQL = """
SELECT o_orderkey AS way,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'primary_link' WHEN '2-HIGH' THEN 'motorway' WHEN '5-LOW' THEN 'residential' ELSE 'footway' END AS highway,
  CASE o_orderkey % 5 WHEN 0 THEN '-1' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END AS oneway,
  CASE WHEN o_orderkey % 7 = 0 THEN 'roundabout' END AS junction
FROM orders"""


def way_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, "lineitem", "orders")
    return spark.sql(WAYS_SQL), spark.sql(WAY_NODES_SQL)


def way_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.ways import class_filter

    return class_filter(way_tables(spark, sf_dir)[0]).select("way", "highway")


def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.ways import segments

    return segments(way_tables(spark, sf_dir)[1]).select("way", "pos", "a", "b")


def oneway_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.ways import class_filter, expand, segments

    ways, nodes = way_tables(spark, sf_dir)
    pairs = segments(nodes).join(class_filter(ways), "way").select("way", "pos", "a", "b", "oneway", "junction")
    return expand(pairs).select("way", "pos", "src", "dst")


def bbox_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.ways import clip, drop_invalid, segments

    nodes = way_tables(spark, sf_dir)[1]
    return segments(clip(drop_invalid(nodes), (10.0, 5.0, 300.0, 45.0))).select("way", "pos", "a", "b")


def invalid_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.ways import drop_invalid, segments

    return segments(drop_invalid(way_tables(spark, sf_dir)[1])).select("way", "pos", "a", "b")


def segments_sql(nodes: str) -> str:
    return f"SELECT way, pos, a, b FROM (SELECT way, pos, node AS a, lead(node) OVER (PARTITION BY way ORDER BY pos) AS b FROM ({nodes})) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b"


# ---------------------------------------------------------------------------------------------
# Coordinates: two numbers of each embedding as longitude and latitude around a centre

POINTS_SQL = "SELECT vec_id AS node, 28.0473 + CAST({0} AS DOUBLE) * 0.5 AS lon, -26.2041 + CAST({1} AS DOUBLE) * 0.5 AS lat, label FROM embeddings"
SPARK_POINTS = POINTS_SQL.format("embedding[0]", "embedding[1]")
DUCK_POINTS = POINTS_SQL.format("embedding[1]", "embedding[2]")
DUCK_HAVERSINE = (
    "2 * 6371000.0 * asin(sqrt(pow(sin((radians({3}) - radians({1})) / 2), 2) + "
    "cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2)))"
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "embeddings")
    return spark.sql(SPARK_POINTS)


def haversine_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.functions.geo import arc_weight, haversine

    rows = points(spark, sf_dir)
    nxt = rows.select((F.col("node") - 1).alias("node"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    both = rows.join(nxt, "node")
    return both.select("node", arc_weight(haversine(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b"))).alias("w"))


def centre_distance():
    from roadwell.functions.geo import haversine

    # whole hundreds of metres, so that ties occur
    return F.floor(haversine(F.col("lon"), F.col("lat"), F.lit(28.0473), F.lit(-26.2041)) / 100)


def centre_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.ways import crop

    return crop(points(spark, sf_dir), centre_distance(), 120).select("node")


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.functions.geo import numbered
    from roadwell.operators.ways import crop, induced, renumber

    kept = materialise(crop(points(spark, sf_dir), centre_distance(), 120).select("node"), "kept")
    rows = points(spark, sf_dir)
    n = rows.count()
    arcs = rows.select(F.col("node").alias("src"), F.explode(F.array(*[(F.col("node") * 7 + k) % n for k in (1, 2, 5)])).alias("dst"), F.lit(1).alias("w"))
    return renumber(induced(arcs, kept), numbered(kept, ["node"], "rank")).select("src", "dst")


def morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.functions.geo import morton_order

    return morton_order(points(spark, sf_dir)).select("node", "code", "rank")


SPREAD_SQL = """
m1 AS (SELECT *, (qx | (qx << 8)) & 16711935 AS x1, (qy | (qy << 8)) & 16711935 AS y1 FROM q),
m2 AS (SELECT *, (x1 | (x1 << 4)) & 252645135 AS x2, (y1 | (y1 << 4)) & 252645135 AS y2 FROM m1),
m3 AS (SELECT *, (x2 | (x2 << 2)) & 858993459 AS x3, (y2 | (y2 << 2)) & 858993459 AS y3 FROM m2),
m4 AS (SELECT *, ((x3 | (x3 << 1)) & 1431655765) | (((y3 | (y3 << 1)) & 1431655765) << 1) AS code FROM m3)"""


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.snap import nearest_node

    rows = points(spark, sf_dir)
    asked = rows.where("label < 3").select(F.col("node").alias("pid"), (F.col("lon") + 0.01).alias("lon"), (F.col("lat") - 0.02).alias("lat"))
    return nearest_node(asked, rows.where("label >= 3").select("node", "lon", "lat"))


def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapped(spark, sf_dir).select("pid", "node", F.round("snap_m", 3).alias("snap_m"))


def snap_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.snap import facility_pool

    rows = snapped(spark, sf_dir).withColumn("facility_id", F.format_string("F%03d", F.col("pid") % 100))
    return facility_pool(rows, 20000.0).select("pool_idx", "facility_id", "node", F.round("snap_m", 1).alias("snap_m"))


SNAP_SQL = f"""
pts AS MATERIALIZED ({DUCK_POINTS}),
net AS MATERIALIZED (SELECT node, lon, lat, cos(radians((SELECT avg(lat) FROM pts WHERE label >= 3))) AS s FROM pts WHERE label >= 3),
asked AS (SELECT node AS pid, lon + 0.01 AS lon, lat - 0.02 AS lat FROM pts WHERE label < 3),
best AS (
  SELECT pid, asked.lon AS plon, asked.lat AS plat, net.node, net.lon, net.lat,
    row_number() OVER (PARTITION BY pid ORDER BY pow(asked.lon * s - net.lon * s, 2) + pow(asked.lat - net.lat, 2), net.node) AS r
  FROM asked CROSS JOIN net),
snapped AS (SELECT pid, plon, plat, node, {DUCK_HAVERSINE.format('lon', 'lat', 'plon', 'plat')} AS snap_m FROM best WHERE r = 1)"""


def facility_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.sources.tables import clean_facilities

    raw = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("id"),
        F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_acctbal").cast("string")).alias("la"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).alias("lo"),
    )
    return clean_facilities(raw, "id", "la", "lo")


# ---------------------------------------------------------------------------------------------
# Strong components: nations with a directed arc where a nation's supplier serves another's customer often

NATION_SQL = """
SELECT s.s_nationkey AS src, c.c_nationkey AS dst
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
WHERE (s.s_nationkey * 7 + c.c_nationkey * 3) % 13 < 2 AND s.s_nationkey <> c.c_nationkey
GROUP BY s.s_nationkey, c.c_nationkey"""


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, "lineitem", "orders", "customer", "supplier", "nation")
    arcs = spark.sql(NATION_SQL).select(F.col("src").cast("long"), F.col("dst").cast("long"))
    return spark.sql("SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation"), arcs


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.components import strong_components as find

    return find(*nation_graph(spark, sf_dir))


def largest_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.operators.components import largest_component

    return largest_component(*nation_graph(spark, sf_dir))


SCC_SQL = f"""
WITH RECURSIVE arcs AS MATERIALIZED ({NATION_SQL}),
reach(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT a, CAST(dst AS BIGINT) FROM reach JOIN arcs ON src = b),
comp AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"""

# ---------------------------------------------------------------------------------------------
# Experiments

GRAPHS = {"small": (5041, 252), "medium": (50176, 2508), "large": (500556, 25027)}
SPEC_SQL = """
spec AS (SELECT *, CAST(greatest(1, pool // 4) AS INTEGER) AS k, CAST(greatest(1, least(5000, n // 5)) AS INTEGER) AS q, 8 AS B
  FROM (VALUES ('small', 5041, 252), ('medium', 50176, 2508), ('large', 500556, 25027)) t(label, n, pool)),
loads AS (
  SELECT label, k, q, B FROM spec
  UNION SELECT label, CAST(pool // d AS INTEGER), q, B FROM spec, (VALUES (16), (8), (4), (2), (1)) t(d) WHERE label = 'medium' AND pool // d >= 1
  UNION SELECT label, k, CAST(least(v, n // 2) AS INTEGER), B FROM spec, (VALUES (100), (1000), (10000), (50000)) t(v) WHERE label = 'medium'
  UNION SELECT label, k, q, v FROM spec, (VALUES (1), (2), (4), (8), (16)) t(v) WHERE label = 'medium'),
cells AS (
  SELECT label, alg, strategy, p, k, q, B FROM loads, (VALUES ('dijkstra'), ('bfs')) a(alg),
    (VALUES ('source'), ('graph'), ('scenario')) s(strategy), (VALUES (1), (2), (4)) t(p))"""


def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.experiment import matrix

    return matrix(spark, GRAPHS)


def experiment_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.experiment import baselines, matrix

    return baselines(matrix(spark, GRAPHS))


def experiment_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.experiment import matrix, todo

    cells = matrix(spark, GRAPHS)
    return todo(cells, cells.where("p = 2 OR alg = 'bfs'"))


def dump_job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.experiment import dump_jobs

    return dump_jobs(spark, GRAPHS)


#: Lines as trial rows; the same text for both engines.
TRIALS_SQL = """
SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'F' THEN 'dijkstra' ELSE 'bfs' END AS alg,
  CASE l_suppkey % 4 WHEN 0 THEN 'seq' WHEN 1 THEN 'source' WHEN 2 THEN 'graph' ELSE 'scenario' END AS strategy,
  CAST(CASE l_suppkey % 4 WHEN 0 THEN 1 ELSE CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END END AS INTEGER) AS p,
  CAST(l_orderkey % 3 + 1 AS INTEGER) AS k, CAST(100 * (l_linenumber % 2 + 1) AS INTEGER) AS q, CAST(4 AS INTEGER) AS B,
  CAST(l_partkey % 6 AS INTEGER) AS trial, CAST(5000 AS BIGINT) AS n, CAST(20000 AS BIGINT) AS m,
  l_extendedprice / 1000 AS wall, l_quantity AS comp_min, l_quantity + l_linenumber AS comp_max, l_quantity + l_linenumber - 1 AS comp_mean,
  l_discount AS wait_mean, l_tax AS xfer_mean, l_orderkey % 1000 AS msgs, CAST(l_linenumber AS INTEGER) AS steps, l_tax AS edge_cut,
  CAST(CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN 0 ELSE 1 END AS INTEGER) AS verified
FROM lineitem"""


def trial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import summary

    views(spark, sf_dir, "lineitem")
    return summary(spark.sql(TRIALS_SQL))


SIX = lambda *names: [F.round(c, 6).alias(c) for c in names]
KEYS = ["label", "alg", "k", "q", "B", "strategy", "p"]


def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = trial_cells(spark, sf_dir)
    return cells.select(*KEYS, "trials", "verified", "n", "m", *SIX("wall", "wall_min", "wall_max", "comp", "wait", "xfer", "msgs", "steps", "edge_cut"))


def load_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_cells(spark, sf_dir).select(*KEYS, *SIX("lb", "comm_frac", "wait_frac", "xfer_frac"))


def speedup_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_cells(spark, sf_dir).select(*KEYS, *SIX("speedup", "speedup_lo", "speedup_hi", "efficiency"))


def unverified_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import unverified

    return unverified(trial_cells(spark, sf_dir))


def default_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(trial_cells(spark, sf_dir), "cells").where("k = 1 AND q = 200 AND B = 4")


def speedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import speedup_rows

    return speedup_rows(default_cells(spark, sf_dir)).select("label", "alg", "strategy", "p", *SIX("speedup", "speedup_lo", "speedup_hi"))


def sweep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import sweep_rows

    cells = materialise(trial_cells(spark, sf_dir), "cells")
    return sweep_rows(cells, 4, {"k": 1, "q": 200, "B": 4}).select("varied", "value", "label", "alg", "strategy", *SIX("speedup"))


def breakdown_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import breakdown

    rows = breakdown(default_cells(spark, sf_dir), 4)
    return rows.select("label", "alg", "strategy", "part", *SIX("seconds", "bottom"))


def main_table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import main_table

    rows = main_table(default_cells(spark, sf_dir), 4)
    return rows.select("label", "alg", "strategy", "t_1", "t_2", "t_top", *SIX("speedup", "efficiency", "lb", "comm_frac"))


SUMMARY_SQL = f"""
trials AS MATERIALIZED ({TRIALS_SQL}),
meas AS (SELECT *, (comp_max - comp_min) / nullif(comp_mean, 0) AS lb, wait_mean / nullif(wall, 0) AS wait_frac, xfer_mean / nullif(wall, 0) AS xfer_frac FROM trials WHERE trial >= 1),
ok AS (SELECT label, alg, k, q, B, strategy, p, min(verified) AS verified FROM trials WHERE trial = 0 GROUP BY ALL),
med AS (
  SELECT label, alg, k, q, B, strategy, p, quantile_cont(wall, 0.5) AS wall, min(wall) AS wall_min, max(wall) AS wall_max, count(*) AS trials,
    quantile_cont(comp_mean, 0.5) AS comp, quantile_cont(wait_mean, 0.5) AS wait, quantile_cont(xfer_mean, 0.5) AS xfer, quantile_cont(lb, 0.5) AS lb,
    quantile_cont(wait_frac + xfer_frac, 0.5) AS comm_frac, quantile_cont(wait_frac, 0.5) AS wait_frac, quantile_cont(xfer_frac, 0.5) AS xfer_frac,
    quantile_cont(CAST(msgs AS DOUBLE), 0.5) AS msgs, quantile_cont(CAST(steps AS DOUBLE), 0.5) AS steps, quantile_cont(edge_cut, 0.5) AS edge_cut, min(n) AS n, min(m) AS m
  FROM meas GROUP BY label, alg, k, q, B, strategy, p),
base AS (SELECT label, alg, k, q, B, wall AS seq_wall FROM med WHERE strategy = 'seq'),
cells AS MATERIALIZED (
  SELECT med.*, ok.verified, seq_wall / nullif(med.wall, 0) AS speedup, seq_wall / nullif(wall_max, 0) AS speedup_lo, seq_wall / nullif(wall_min, 0) AS speedup_hi,
    seq_wall / nullif(med.wall, 0) / p AS efficiency
  FROM med LEFT JOIN ok USING (label, alg, k, q, B, strategy, p) LEFT JOIN base USING (label, alg, k, q, B)),
dflt AS (SELECT * FROM cells WHERE k = 1 AND q = 200 AND B = 4)"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


def run_stats_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an order stands for a process of the run that the order belongs to."""
    from roadwell.plans.trials import process_times

    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("run"), F.col("l_extendedprice").alias("wall"), F.col("l_discount").alias("wait"),
        F.col("l_tax").alias("xfer"), F.col("l_linenumber").alias("msgs"),
    )
    found = process_times(rows, "run")
    return found.select("run", "wall", *SIX("comp_min", "comp_max"), F.round("comp_mean", 4).alias("comp_mean"), *SIX("wait_mean", "xfer_mean"), "msgs")


def run_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warm-up and a trial of each strategy on the supply graph, held against the sequential answers; without the times."""
    from roadwell.plans.trials import RoadGraph
    from roadwell.plans.trials import run_trials as run

    n, m, arcs = dense_graph(spark, sf_dir)
    # suppliers have the lowest numbers of all nodes
    size = table(spark, sf_dir, "supplier").select("s_suppkey").distinct().count()
    pool = spark.range(size).select(F.col("id").alias("pool_idx"), F.col("id").alias("node"))
    roads, out = RoadGraph(arcs, n, m, pool, size), None
    for strategy, p in (("seq", 1), ("source", 3), ("graph", 3), ("scenario", 2)):
        rows = run(roads, "dijkstra", strategy, p, k=size // 4, q=500, B=3, trials=1, label="supply", verify=True).rows
        out = rows if out is None else out.unionByName(rows)
    roads.close()
    # rounds and exchanged labels depend on how the graph is cut, the times on the machine
    counted = (F.col("strategy") != "graph") | (F.col("p") == 1)
    return out.select(
        "label", "n", "m", "alg", "strategy", "p", "k", "q", "B", "pool", "trial", F.when(counted, F.col("msgs")).alias("msgs"),
        F.when(counted, F.col("steps")).alias("steps"), "verified",
    )


# ---------------------------------------------------------------------------------------------
# Two metrics compared: dumps made from orders, a graph and k for each priority

DUMPS_SQL = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'small' ELSE 'medium' END AS graph, CAST(o_custkey % 3 + 1 AS INTEGER) AS k, alg,
  o_orderkey AS qidx, o_custkey AS node, CASE WHEN alg = 'bfs' AND o_orderkey % 7 = 0 THEN o_custkey % 50 + 1 ELSE o_custkey % 50 END AS school_idx,
  CAST(CASE WHEN alg = 'bfs' THEN o_custkey % 23 ELSE (o_custkey % 23) * 90 + o_orderkey % 61 END AS BIGINT) AS dist
FROM orders, (SELECT 'dijkstra' AS alg UNION ALL SELECT 'bfs' AS alg) algs"""


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(DUMPS_SQL)


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import differences

    return differences(dumps(spark, sf_dir))


def dijkstra_vs_bfs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_rows(spark, sf_dir).select("graph", "k", "origins", *SIX("nearest_school_differs", "mean_road_km", "mean_hops"))


def m_per_hop_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_rows(spark, sf_dir).select("graph", "k", *SIX("iqr_m_per_hop_lo", "median_m_per_hop", "iqr_m_per_hop_hi"))


def spearman_dist_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_rows(spark, sf_dir).select("graph", "k", *SIX("spearman_dist_vs_hops"))


def diff_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff_rows(spark, sf_dir)
    return rows.select("graph", "k", F.round(100 * F.col("nearest_school_differs"), 4).alias("differs_percent"))


def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.plans.analysis import scatter

    return scatter(dumps(spark, sf_dir)).select("qidx", "hops", *SIX("km"))


PAIRED_SQL = f"""
d AS MATERIALIZED ({DUMPS_SQL}),
two AS MATERIALIZED (
  SELECT a.graph, a.k, a.qidx, a.node, a.school_idx AS iw, b.school_idx AS ih, a.dist AS dw, b.dist AS dh, a.dist / CAST(greatest(b.dist, 1) AS DOUBLE) AS mph
  FROM d a JOIN d b ON a.graph = b.graph AND a.k = b.k AND a.qidx = b.qidx AND a.node = b.node WHERE a.alg = 'dijkstra' AND b.alg = 'bfs')"""


def meta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a prepared graph: its nodes and arcs, and facilities listed, kept and dropped."""
    listed = facility_clean(spark, sf_dir).count()
    kept = snapped(spark, sf_dir).where("snap_m <= 20000").count()
    asked = points(spark, sf_dir).where("label < 3").count()
    n, m, _ = dense_graph(spark, sf_dir)
    return spark.createDataFrame([(n, m, listed, kept, asked - kept)], "nodes long, edges long, listed long, in_pool long, dropped long")


def file_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.sources.tables import sha256_of_files

    return sha256_of_files(spark, f"{sf_dir}/nation.parquet")


def queries() -> dict:
    return {
        "nearest_weighted": supply_answers(one_scenario, "weighted"),
        "nearest_hops": supply_answers(one_scenario, "hops"),
        "nearest_weighted_directed": supply_answers(one_scenario, "weighted", both_ways=False),
        "nearest_scenarios_weighted": supply_answers(four_scenarios, "weighted"),
        "nearest_scenarios_hops": supply_answers(four_scenarios, "hops"),
        "strategy_seq": supply_answers(four_scenarios, "weighted", "seq"),
        "strategy_source": supply_answers(four_scenarios, "weighted", "source"),
        "strategy_graph": supply_answers(four_scenarios, "hops", "graph"),
        "strategy_scenario": supply_answers(four_scenarios, "hops", "scenario"),
        "colocated_facilities": colocated,
        "verify_mismatch": verify_mismatch,
        "completeness_check": completeness_check,
        "origin_dump": origin_dump,
        "bfs_level_histogram": bfs_level_histogram,
        "bfs_steps": bfs_steps,
        "degree_prefix": degree_prefix,
        "csr_rows": csr,
        "partition_bounds": partition_bounds,
        "owner_lookup": owner_lookup,
        "edge_cut": edge_cut_share,
        "splitmix_stream": splitmix_stream,
        "grid_candidates": grid_candidates,
        "synth_graph": synth_graph,
        "query_sample": query_sample,
        "scenario_sample": scenario_sample,
        "synth_pool": synth_pool,
        "way_class_filter": way_class_filter,
        "way_segments": way_segments,
        "oneway_expand": oneway_expand,
        "bbox_gap": bbox_gap,
        "invalid_bridge": invalid_bridge,
        "haversine_weight": haversine_weight,
        "centre_crop": centre_crop,
        "induced_subgraph": induced_subgraph,
        "morton_order": morton,
        "snap_nearest": snap_nearest,
        "snap_pool": snap_pool,
        "facility_clean": facility_clean,
        "strong_components": strong_components,
        "largest_scc": largest_scc,
        "experiment_matrix": experiment_matrix,
        "experiment_baselines": experiment_baselines,
        "experiment_todo": experiment_todo,
        "dump_jobs": dump_job_list,
        "trial_summary": trial_summary,
        "load_balance": load_balance,
        "speedup_efficiency": speedup_efficiency,
        "unverified_cells": unverified_cells,
        "speedup_rows": speedup_lines,
        "sweep_rows": sweep_lines,
        "breakdown_stacked": breakdown_stacked,
        "main_table_pivot": main_table_pivot,
        "run_stats_reduce": run_stats_reduce,
        "run_trials": run_trials,
        "dijkstra_vs_bfs_diff": dijkstra_vs_bfs_diff,
        "m_per_hop_quantiles": m_per_hop_quantiles,
        "spearman_dist_hops": spearman_dist_hops,
        "diff_by_k": diff_by_k,
        "scatter_sample": scatter_sample,
        "meta_summary": meta_summary,
        "file_sha256": file_sha256,
    }


def oracle_sql() -> dict[str, str]:
    four_w, four_h = search_sql(FOUR, "weighted", ANSWERS), search_sql(FOUR, "hops", ANSWERS)
    directed = "SELECT a AS src, b AS dst, w FROM pairs"
    expand = (
        "SELECT way, pos, a AS src, b AS dst FROM s WHERE coalesce(oneway, '') <> '-1' UNION ALL "
        "SELECT way, pos, b AS src, a AS dst FROM s WHERE oneway = '-1' OR (NOT coalesce(oneway IN ('yes', 'true', '1'), false) AND junction IS NULL)"
    )
    classes = "regexp_replace(highway, '_link$', '') IN ('primary', 'secondary', 'tertiary', 'unclassified', 'residential')"
    valid = f"SELECT * FROM ({WAY_NODES_SQL}) WHERE lon IS NOT NULL AND lat IS NOT NULL"
    clipped = f"SELECT way, pos, lon, lat, CASE WHEN lon BETWEEN 10 AND 300 AND lat BETWEEN 5 AND 45 THEN node END AS node FROM ({valid})"
    crop = f"""WITH pts AS ({DUCK_POINTS}), d AS (SELECT node, floor({DUCK_HAVERSINE.format('lon', 'lat', '28.0473', '(-26.2041)')} / 100) AS d FROM pts),
kept AS (SELECT node FROM (SELECT node, rank() OVER (ORDER BY d) AS r FROM d) WHERE r <= 120)"""
    stacked = "".join(
        f"{' UNION ALL ' if k else ''}SELECT label, alg, strategy, '{part}' AS part, round(coalesce({part}, 0), 6) AS seconds, round({below}, 6) AS bottom FROM full_rows"
        for k, (part, below) in enumerate((("comp", "0.0"), ("wait", "coalesce(comp, 0)"), ("xfer", "coalesce(comp, 0) + coalesce(wait, 0)")))
    )
    sweeps = " UNION ALL ".join(
        f"SELECT '{name}' AS varied, {name} AS value, label, alg, strategy, round(speedup, 6) AS speedup FROM cells WHERE p = 4 AND strategy <> 'seq' AND {rest}"
        for name, rest in (("k", "q = 200 AND B = 4"), ("q", "k = 1 AND B = 4"), ("B", "k = 1 AND q = 200"))
    )
    moved = "(SELECT * FROM two WHERE dh > 0 AND dw > 0)"
    return {
        "nearest_weighted": search_sql(ONE, "weighted", ANSWERS),
        "nearest_hops": search_sql(ONE, "hops", ANSWERS),
        "nearest_weighted_directed": search_sql(ONE, "weighted", ANSWERS, directed),
        "nearest_scenarios_weighted": four_w,
        "nearest_scenarios_hops": four_h,
        "strategy_seq": four_w,
        "strategy_source": four_w,
        "strategy_graph": four_h,
        "strategy_scenario": four_h,
        "colocated_facilities": search_sql(COLOCATED, "weighted", ANSWERS),
        "verify_mismatch": "SELECT CAST(s AS INTEGER) AS scenario, count(*) AS compared, CAST(0 AS BIGINT) AS mismatches FROM orders, (VALUES (0), (1), (2), (3)) t(s) GROUP BY s",
        "completeness_check": "SELECT CAST(0 AS BIGINT) AS unplaced, CAST(0 AS BIGINT) AS outside",
        "origin_dump": search_sql(FOUR, "weighted", "SELECT qidx, node, coalesce(pool_idx, 4294967295) AS school_idx, coalesce(dist, 4294967295) AS dist FROM answers WHERE scenario = 0", directed),
        "bfs_level_histogram": search_sql(FOUR, "hops", "SELECT s AS scenario, l // 4294967296 AS hops, count(*) AS nodes FROM lab GROUP BY ALL"),
        "bfs_steps": search_sql(FOUR, "hops", "SELECT CAST(sum(n) AS BIGINT) AS steps FROM (SELECT s, max(l // 4294967296) + 1 AS n FROM lab GROUP BY s)"),
        "degree_prefix": f"WITH {DENSE_SQL} SELECT node, degree, xadj FROM deg",
        "csr_rows": f"""WITH {DENSE_SQL}, lists AS (
  SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst, w) AS adj, string_agg(CAST(w AS VARCHAR), ',' ORDER BY dst, w) AS w FROM dense GROUP BY src)
SELECT node, degree, xadj, coalesce(adj, '') AS adj, coalesce(w, '') AS w FROM deg LEFT JOIN lists ON src = node""",
        "partition_bounds": f"WITH {BOUNDS_SQL} SELECT r, first FROM bounds",
        "owner_lookup": f"WITH {BOUNDS_SQL} SELECT id AS node, CAST((SELECT count(*) FROM bounds WHERE first <= id) AS INTEGER) AS part FROM ids",
        "edge_cut": f"WITH {BOUNDS_SQL}, own AS (SELECT id, (SELECT count(*) FROM bounds WHERE first <= id) AS part FROM ids) SELECT round(avg(CASE WHEN x.part <> y.part THEN 1.0 ELSE 0.0 END), 9) AS edge_cut FROM dense JOIN own x ON x.id = src JOIN own y ON y.id = dst",
        "splitmix_stream": "WITH " + SPLITMIX_STEPS.format(seed=42, i="i", src="(SELECT o_orderkey AS i FROM orders)") + " SELECT i, CAST(CASE WHEN z >= 9223372036854775808 THEN CAST(z AS HUGEINT) - CAST(18446744073709551616 AS HUGEINT) ELSE CAST(z AS HUGEINT) END AS BIGINT) AS bits, CAST(z % 271 AS BIGINT) AS below_271 FROM s3",
        "grid_candidates": """WITH cells AS (SELECT range AS v, range // 71 AS y, range % 71 AS x FROM range(71 * 71)),
edges AS (
  SELECT v AS a, v + 1 AS b, 0 AS o FROM cells WHERE x < 70 UNION ALL SELECT v AS a, v + 71 AS b, 1 AS o FROM cells WHERE y < 70),
ranked AS (SELECT row_number() OVER (ORDER BY a, o) - 1 AS idx, a, b FROM edges), """ + SPLITMIX_STEPS.format(seed=42, i="idx", src="ranked") + " SELECT idx, a, b, CAST(30 + z % 271 AS BIGINT) AS w FROM s3",
        "way_class_filter": f"SELECT way, highway FROM ({WAYS_SQL}) WHERE {classes}",
        "way_segments": segments_sql(WAY_NODES_SQL),
        "oneway_expand": f"WITH s AS (SELECT * FROM ({segments_sql(WAY_NODES_SQL)}) JOIN (SELECT * FROM ({WAYS_SQL}) WHERE {classes}) USING (way)) {expand}",
        "bbox_gap": segments_sql(clipped),
        "invalid_bridge": segments_sql(valid),
        "haversine_weight": f"WITH pts AS ({DUCK_POINTS}) SELECT a.node, CAST(greatest(1, round_even({DUCK_HAVERSINE.format('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 0)) AS BIGINT) AS w FROM pts a JOIN pts b ON b.node = a.node + 1",
        "centre_crop": f"{crop} SELECT node FROM kept",
        "induced_subgraph": f"""{crop}, num AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS rank FROM kept),
arcs AS (SELECT node AS src, (node * 7 + k) % (SELECT count(*) FROM pts) AS dst FROM pts, (VALUES (1), (2), (5)) t(k))
SELECT x.rank AS src, y.rank AS dst FROM arcs JOIN num x ON x.node = src JOIN num y ON y.node = dst""",
        "morton_order": f"""WITH pts AS ({DUCK_POINTS}), box AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM pts),
q AS (SELECT node, CAST(floor((lon - x0) / greatest(x1 - x0, 1e-12) * 65535) AS BIGINT) AS qx, CAST(floor((lat - y0) / greatest(y1 - y0, 1e-12) * 65535) AS BIGINT) AS qy FROM pts, box),
{SPREAD_SQL} SELECT node, code, row_number() OVER (ORDER BY code, node) - 1 AS rank FROM m4""",
        "snap_nearest": f"WITH {SNAP_SQL} SELECT pid, node, round(snap_m, 3) AS snap_m FROM snapped",
        "snap_pool": f"WITH {SNAP_SQL}, f AS (SELECT *, printf('F%03d', pid % 100) AS facility_id FROM snapped WHERE snap_m <= 20000) SELECT row_number() OVER (ORDER BY facility_id, plat, plon) - 1 AS pool_idx, facility_id, node, round(snap_m, 1) AS snap_m FROM f",
        "facility_clean": "SELECT c_name AS facility_id, c_acctbal AS lat, CAST(c_nationkey AS DOUBLE) AS lon FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 9 <> 0",
        "strong_components": f"{SCC_SQL} SELECT node, component FROM comp",
        "largest_scc": f"{SCC_SQL} SELECT node FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
        "experiment_matrix": f"WITH {SPEC_SQL} SELECT label, alg, strategy, p, k, q, B FROM cells",
        "experiment_baselines": f"WITH {SPEC_SQL} SELECT DISTINCT label, alg, 'seq' AS strategy, 1 AS p, k, q, B FROM cells",
        "experiment_todo": f"WITH {SPEC_SQL} SELECT label, alg, strategy, p, k, q, B FROM cells WHERE p <> 2 AND alg <> 'bfs'",
        "dump_jobs": f"WITH {SPEC_SQL}, ks AS (SELECT label, n, k FROM spec UNION SELECT label, n, CAST(pool // d AS INTEGER) FROM spec, (VALUES (16), (4), (1)) t(d) WHERE label = 'medium') SELECT label, alg, k, CAST(least(20000, n // 2) AS INTEGER) AS q, 1 AS B FROM ks, (VALUES ('dijkstra'), ('bfs')) a(alg) WHERE k >= 1",
        "trial_summary": f"WITH {SUMMARY_SQL} SELECT label, alg, k, q, B, strategy, p, trials, verified, n, m, {rounded('wall', 'wall_min', 'wall_max', 'comp', 'wait', 'xfer', 'msgs', 'steps', 'edge_cut')} FROM cells",
        "load_balance": f"WITH {SUMMARY_SQL} SELECT label, alg, k, q, B, strategy, p, {rounded('lb', 'comm_frac', 'wait_frac', 'xfer_frac')} FROM cells",
        "speedup_efficiency": f"WITH {SUMMARY_SQL} SELECT label, alg, k, q, B, strategy, p, {rounded('speedup', 'speedup_lo', 'speedup_hi', 'efficiency')} FROM cells",
        "unverified_cells": f"WITH {SUMMARY_SQL} SELECT count(*) AS cells, count(CASE WHEN strategy <> 'seq' AND verified IS DISTINCT FROM 1 THEN 1 END) AS unverified FROM cells",
        "speedup_rows": f"WITH {SUMMARY_SQL}, own AS (SELECT * FROM dflt WHERE strategy <> 'seq') SELECT label, alg, strategy, p, {rounded('speedup', 'speedup_lo', 'speedup_hi')} FROM own UNION ALL SELECT DISTINCT label, alg, 'ideal', p, CAST(p AS DOUBLE), CAST(p AS DOUBLE), CAST(p AS DOUBLE) FROM own",
        "sweep_rows": f"WITH {SUMMARY_SQL} {sweeps}",
        "breakdown_stacked": f"WITH {SUMMARY_SQL}, full_rows AS (SELECT g.label, g.alg, g.strategy, comp, wait, xfer FROM (SELECT DISTINCT label, alg, st AS strategy FROM dflt, (VALUES ('source'), ('graph'), ('scenario')) t(st)) g LEFT JOIN (SELECT * FROM dflt WHERE p = 4) d ON d.label = g.label AND d.alg = g.alg AND d.strategy = g.strategy) {stacked}",
        "main_table_pivot": f"""WITH {SUMMARY_SQL}, own AS (SELECT * FROM dflt WHERE strategy <> 'seq'),
t AS (SELECT label, alg, strategy, p, printf('%.3f', wall) AS t FROM own)
SELECT o.label, o.alg, o.strategy, coalesce(a.t, '-') AS t_1, coalesce(b.t, '-') AS t_2, coalesce(c.t, '-') AS t_top, round(speedup, 6) AS speedup, round(efficiency, 6) AS efficiency, round(lb, 6) AS lb, round(comm_frac, 6) AS comm_frac
FROM (SELECT * FROM own WHERE p = 4) o LEFT JOIN t a ON a.label = o.label AND a.alg = o.alg AND a.strategy = o.strategy AND a.p = 1
LEFT JOIN t b ON b.label = o.label AND b.alg = o.alg AND b.strategy = o.strategy AND b.p = 2
LEFT JOIN t c ON c.label = o.label AND c.alg = o.alg AND c.strategy = o.strategy AND c.p = 4""",
        "run_trials": f"""WITH {DENSE_SQL},
runs(strategy, p) AS (VALUES ('seq', 1), ('source', 3), ('graph', 3), ('scenario', 2)),
sizes AS (SELECT (SELECT count(*) FROM ids) AS n, (SELECT count(*) FROM dense) AS m, (SELECT count(DISTINCT s_suppkey) FROM supplier) AS pool),
work AS (SELECT *, CAST(pool // 4 AS INTEGER) AS k, CAST(least(500, n) AS INTEGER) AS q, 3 AS B FROM sizes)
SELECT 'supply' AS label, n, m, 'dijkstra' AS alg, strategy, p, k, q, B, CAST(pool AS INTEGER) AS pool, CAST(trial AS INTEGER) AS trial,
  CAST(CASE strategy WHEN 'seq' THEN 0 WHEN 'source' THEN p * B * q WHEN 'scenario' THEN B * q ELSE CASE WHEN p = 1 THEN B * q END END AS BIGINT) AS msgs,
  CAST(CASE strategy WHEN 'scenario' THEN (B + p - 1) // p WHEN 'graph' THEN CASE WHEN p = 1 THEN B END ELSE B END AS INTEGER) AS steps,
  CAST(CASE WHEN trial = 0 AND strategy <> 'seq' THEN 1 ELSE -1 END AS INTEGER) AS verified
FROM work CROSS JOIN runs CROSS JOIN range(2) t(trial)""",
        "meta_summary": f"""WITH {DENSE_SQL}, {SNAP_SQL}
SELECT (SELECT count(*) FROM ids) AS nodes, (SELECT count(*) FROM dense) AS edges,
  (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 9 <> 0) AS listed,
  (SELECT count(*) FROM snapped WHERE snap_m <= 20000) AS in_pool, (SELECT count(*) FROM snapped WHERE snap_m > 20000) AS dropped""",
        "query_sample": draws_sql("(SELECT 0 AS s, CAST(42 AS UHUGEINT) AS seed)", 5041, 1008, "SELECT i AS qidx, v AS node FROM drawn"),
        "scenario_sample": draws_sql(
            "(SELECT range AS s, CAST(42 * 1000003 + range + 1 AS UHUGEINT) AS seed FROM range(8))", 252, 63,
            "SELECT CAST(s AS INTEGER) AS scenario, CAST(i AS INTEGER) AS pos, v AS pool_idx FROM drawn",
        ),
        "synth_pool": draws_sql(f"(SELECT 0 AS s, CAST({42 ^ 0xABCDEF} AS UHUGEINT) AS seed)", 5041, 252, "SELECT i AS pool_idx, v AS node FROM drawn"),
        "run_stats_reduce": "SELECT l_orderkey % 100 AS run, max(l_extendedprice) AS wall, round(min(l_extendedprice - l_discount - l_tax), 6) AS comp_min, round(max(l_extendedprice - l_discount - l_tax), 6) AS comp_max, round(avg(l_extendedprice - l_discount - l_tax), 4) AS comp_mean, round(avg(l_discount), 6) AS wait_mean, round(avg(l_tax), 6) AS xfer_mean, CAST(sum(l_linenumber) AS BIGINT) AS msgs FROM lineitem GROUP BY 1",
        "dijkstra_vs_bfs_diff": f"WITH {PAIRED_SQL} SELECT graph, k, count(*) AS origins, round(avg(CASE WHEN iw <> ih THEN 1.0 ELSE 0.0 END), 6) AS nearest_school_differs, round(avg(dw) / 1000, 6) AS mean_road_km, round(avg(dh), 6) AS mean_hops FROM two GROUP BY graph, k",
        "m_per_hop_quantiles": f"WITH {PAIRED_SQL} SELECT graph, k, round(quantile_cont(mph, 0.25), 6) AS iqr_m_per_hop_lo, round(quantile_cont(mph, 0.5), 6) AS median_m_per_hop, round(quantile_cont(mph, 0.75), 6) AS iqr_m_per_hop_hi FROM {moved} GROUP BY graph, k",
        "spearman_dist_hops": f"WITH {PAIRED_SQL}, r AS (SELECT graph, k, rank() OVER (PARTITION BY graph, k ORDER BY dw) + (count(*) OVER (PARTITION BY graph, k, dw) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY graph, k ORDER BY dh) + (count(*) OVER (PARTITION BY graph, k, dh) - 1) / 2.0::DOUBLE AS y FROM {moved}) SELECT graph, k, round(corr(x, y), 6) AS spearman_dist_vs_hops FROM r GROUP BY graph, k",
        "diff_by_k": f"WITH {PAIRED_SQL} SELECT graph, k, round(100 * avg(CASE WHEN iw <> ih THEN 1.0 ELSE 0.0 END), 4) AS differs_percent FROM two GROUP BY graph, k",
        "scatter_sample": f"WITH {PAIRED_SQL}, top AS (SELECT graph, k FROM two GROUP BY graph, k ORDER BY k DESC, graph LIMIT 1) SELECT qidx, dh AS hops, round(dw / 1000.0::DOUBLE, 6) AS km FROM two JOIN top USING (graph, k) ORDER BY md5(CAST(qidx AS VARCHAR)), qidx LIMIT 4000",
    }
