"""The road-graph engine against plain Python on small graphs and against its SQL on the driver's tables."""

import heapq
import itertools
import math
import os
import random
import struct

import pytest

from roadwell.functions import rng
from roadwell.functions.geo import haversine, morton_order, numbered
from roadwell.functions.text import three_decimals
from roadwell.operators import partition, snap, ways
from roadwell.operators.components import largest_component, strong_components
from roadwell.operators.verify import mismatches, unplaced
from roadwell.plans.nearest import nearest_facility, transpose
from roadwell.plans.workload import Workload, synthetic_pool
from roadwell.sources import graph_files, synthetic, tables


def search(arcs, seeds, hops):
    """Least (distance, facility) of each node."""
    out = {}
    for a, b, w in arcs:
        out.setdefault(a, []).append((b, 1 if hops else w))
    best = {}
    heap = [(0, f, n) for n, f in seeds]
    heapq.heapify(heap)
    while heap:
        d, f, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = (d, f)
        for m, w in out.get(n, ()):
            if m not in best:
                heapq.heappush(heap, (d + w, f, m))
    return best


@pytest.fixture(scope="module")
def grid(spark):
    graph = synthetic.synthetic_graph(spark, 225, 42)
    work = Workload(n=225, pool=30, k=7, q=40, B=3)
    pool = synthetic_pool(spark, 225, 30)
    return graph, work, pool


@pytest.mark.parametrize("metric,strategy", list(itertools.product(["weighted", "hops"], ["seq", "source", "graph", "scenario"])))
def test_strategies_agree(spark, grid, metric, strategy):
    graph, work, pool = grid
    scenarios, origins = work.scenarios(spark), work.origins(spark)
    got = nearest_facility(graph, pool, scenarios, origins, metric, strategy, parts=3).collect()
    node = {r.pool_idx: r.node for r in pool.collect()}
    arcs = [tuple(r) for r in graph.select("src", "dst", "w").collect()]
    asked = {r.qidx: r.node for r in origins.collect()}
    chosen = {}
    for r in scenarios.collect():
        chosen.setdefault(r.scenario, []).append((node[r.pool_idx], r.pool_idx))
    assert len(got) == 3 * 40
    for s, seeds in chosen.items():
        best = search(arcs, seeds, metric == "hops")
        for r in (r for r in got if r.scenario == s):
            assert r.node == asked[r.qidx] and (r.dist, r.pool_idx) == best[r.node]


def test_ties_colocation_orientation_and_empty_scenarios(spark):
    travel = spark.createDataFrame([(0, 1, 5), (1, 2, 5), (3, 2, 5), (2, 3, 5)], "src long, dst long, w long")
    pool = spark.createDataFrame([(9, 2), (4, 2), (1, 7)], "pool_idx long, node long")
    scenarios = spark.createDataFrame([(0, 0, 9), (0, 1, 4), (1, 0, 1)], "scenario int, pos int, pool_idx long")
    origins = spark.createDataFrame([(0, 0), (1, 3), (2, 7)], "qidx long, node long")
    got = {(r.scenario, r.qidx): (r.pool_idx, r.dist) for r in nearest_facility(transpose(travel), pool, scenarios, origins).collect()}
    assert got == {(0, 0): (4, 10), (0, 1): (4, 5), (0, 2): (None, None), (1, 0): (None, None), (1, 1): (None, None), (1, 2): (1, 0)}
    with pytest.raises(ValueError):
        nearest_facility(travel, pool, scenarios, origins, strategy="other")
    with pytest.raises(ValueError):
        nearest_facility(travel, pool, scenarios, origins, metric="other")
    dumped = tables.dump(nearest_facility(transpose(travel), pool, scenarios, origins)).orderBy("qidx").collect()
    assert [tuple(r) for r in dumped] == [(0, 0, 4, 10), (1, 3, 4, 5), (2, 7, 4294967295, 4294967295)]


def test_verification(spark):
    one = spark.createDataFrame([(0, 0, 5, 1, 2), (0, 1, 6, None, None), (1, 0, 5, 3, 4)], "scenario int, qidx long, node long, pool_idx long, dist long")
    two = spark.createDataFrame([(0, 0, 5, 1, 2), (0, 1, 6, None, None), (1, 0, 5, 3, 5)], one.schema)
    assert {r.scenario: r.mismatches for r in mismatches(one, two).collect()} == {0: 0, 1: 1}
    assert tuple(unplaced(one, 2, 2).first()) == (1, 0)
    assert tuple(unplaced(one.unionByName(one), 1, 2).first()) == (2, 2)


def test_public_vector_of_the_generator(spark):
    want = [6457827717110365317, 3203168211198807973, 9817491932198370423, 4593380528125082431, 16408922859458223821]
    assert list(itertools.islice(rng.stream(1234567), 5)) == want
    from pyspark.sql import functions as F

    rows = spark.range(5).select("id", rng.next_long(1234567, F.col("id")).alias("x"), rng.below(1234567, F.col("id"), 271).alias("m")).orderBy("id").collect()
    assert [r.x % (1 << 64) for r in rows] == want and [r.m for r in rows] == [v % 271 for v in want]
    assert rng.draw(5, 10, 99) and sorted(rng.draw(5, 10, 99)) == list(range(10))


def test_grid_edges_and_weights(spark):
    for target in (1, 2, 7, 50, 90):
        wide, high = synthetic.grid_size(target)
        assert wide * high >= target and wide == math.ceil(math.sqrt(target))
        draws, want = rng.stream(9), []
        for y in range(high):
            for x in range(wide):
                v = y * wide + x
                if x + 1 < wide:
                    want.append((v, v + 1, 30 + next(draws) % 271))
                if y + 1 < high:
                    want.append((v, v + wide, 30 + next(draws) % 271))
        got = synthetic.grid_candidates(spark, target, 9).orderBy("idx").collect()
        assert [(r.idx, r.a, r.b, r.w) for r in got] == [(k, *e) for k, e in enumerate(want)]
    graph = synthetic.synthetic_graph(spark, 90, 1)
    assert strong_components(spark.range(90).withColumnRenamed("id", "node"), graph).select("component").distinct().count() == 1
    with pytest.raises(ValueError):
        synthetic_pool(spark, 10, 11)


def test_workload_is_clamped(spark):
    work = Workload(n=20, pool=5, k=100, q=1000, B=2)
    assert (work.k, work.q) == (5, 20)
    assert sorted(r.node for r in work.origins(spark).collect()) == list(range(20))
    assert work.scenarios(spark).count() == 10
    assert Workload(n=20, pool=5, k=0, q=1, B=2).scenarios(spark).count() == 0


def test_ways_to_arcs(spark):
    nodes = spark.createDataFrame(
        [(1, 0, 10, 1.0, 1.0), (1, 1, 11, None, None), (1, 2, 12, 3.0, 1.0), (1, 3, 12, 3.0, 1.0), (1, 4, 13, 9.0, 1.0), (1, 5, 14, 4.0, 1.0)],
        "way long, pos int, node long, lon double, lat double",
    )
    pair = lambda frame: [(r.a, r.b) for r in ways.segments(frame).orderBy("pos").collect()]
    valid = ways.drop_invalid(nodes)
    assert pair(valid) == [(10, 12), (12, 13), (13, 14)]
    assert pair(ways.clip(valid, (1.0, 1.0, 4.0, 1.0))) == [(10, 12)]
    kinds = spark.createDataFrame([("primary",), ("primary_link",), ("primary_link_link",), ("motorway",), (None,)], "highway string")
    assert [r[0] for r in ways.class_filter(kinds).collect()] == ["primary", "primary_link"]
    tags = spark.createDataFrame([(1, 2, None, None), (3, 4, "yes", None), (5, 6, "-1", "roundabout"), (7, 8, "no", "roundabout")], "a long, b long, oneway string, junction string")
    arcs = lambda **k: sorted((r.src, r.dst) for r in ways.expand(tags, **k).collect())
    assert arcs() == [(1, 2), (2, 1), (3, 4), (6, 5), (7, 8)]
    assert len(arcs(ignore_oneway=True)) == 8


def test_crop_keeps_ties(spark):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(i, float(d)) for i, d in enumerate([5, 1, 3, 3, 3, 9])], "node long, d double")
    crop = lambda n: sorted(r.node for r in ways.crop(nodes, F.col("d"), n).collect())
    assert crop(2) == [1, 2, 3, 4] and crop(0) == crop(99) == list(range(6))


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    from roadwell.operators import components

    monkeypatch.setattr(components, "LOCAL", most)
    rnd = random.Random(1)
    arcs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)]
    reach = {a: {a} for a in range(30)}
    for _ in range(30):
        for a, b in arcs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in range(30)}
    nodes = spark.range(30).withColumnRenamed("id", "node")
    frame = spark.createDataFrame(arcs, "src long, dst long")
    assert {r.node: r.component for r in strong_components(nodes, frame).collect()} == want
    sizes = {c: sum(x == c for x in want.values()) for c in want.values()}
    best = min(sizes, key=lambda c: (-sizes[c], c))
    assert sorted(r.node for r in largest_component(nodes, frame).collect()) == sorted(a for a in want if want[a] == best)


def test_nearest_nodes_and_pool(spark):
    rnd = random.Random(3)
    nodes = [(i, rnd.gauss(28, 0.01), rnd.gauss(-26, 0.01)) for i in range(300)] + [(300, 29.5, -25.0), (301, 29.5, -25.0)]
    points = [(i, rnd.gauss(28, 0.3), rnd.gauss(-26, 0.3)) for i in range(60)] + [(60, 29.5, -25.0)]
    scale = math.cos(math.radians(sum(n[2] for n in nodes) / len(nodes)))
    near = lambda p: min(nodes, key=lambda n: ((n[1] - p[1]) ** 2 * scale**2 + (n[2] - p[2]) ** 2, n[0]))[0]
    got = snap.nearest_node(spark.createDataFrame(points, "pid long, lon double, lat double"), spark.createDataFrame(nodes, "node long, lon double, lat double"))
    assert {r.pid: r.node for r in got.collect()} == {p[0]: near(p) for p in points}
    rows = spark.createDataFrame([("b", 1.0, 2.0, 5.0), ("a", 3.0, 4.0, 2000.0), ("a", 1.0, 1.0, 1000.0)], "facility_id string, lat double, lon double, snap_m double")
    assert [(r.pool_idx, r.facility_id) for r in snap.facility_pool(rows).orderBy("pool_idx").collect()] == [(0, "a"), (1, "b")]


def test_partition_rule(spark):
    rnd = random.Random(5)
    n, arcs = 40, [(rnd.choice([0, 3, 9, rnd.randrange(38)]), rnd.randrange(40), 1) for _ in range(90)]
    frame = spark.createDataFrame(arcs, "src long, dst long, w long")
    xadj = [sum(a < v for a, _, _ in arcs) for v in range(n)]
    for parts in (1, 3, 7):
        want = [0] + [next((v for v in range(n) if xadj[v] >= len(arcs) * r // parts), n) for r in range(1, parts)] + [n]
        got = partition.bounds(partition.degrees(n, frame), n, len(arcs), parts)
        assert got == want
        own = lambda v: next(r for r in range(parts) if v < want[r + 1])  # noqa: E731, B023
        cut = sum(own(a) != own(b) for a, b, _ in arcs) / len(arcs)
        assert math.isclose(partition.edge_cut(frame, got).first()[0], cut)
    assert partition.edge_cut(frame.limit(0), [0, 40]).first()[0] == 0.0


def test_graph_files(spark, tmp_path):
    arcs = spark.createDataFrame([(0, 2, 5), (2, 1, 7), (2, 0, 3), (2, 0, 3)], "src long, dst long, w long")
    path = str(tmp_path / "graph.bin")
    graph_files.write_graph(path, 4, arcs)
    raw = open(path, "rb").read()
    assert raw[:4] == b"NSG1" and struct.unpack("<15I", raw[4:]) == (4, 4, 0, 1, 1, 4, 4, 2, 0, 0, 1, 5, 3, 3, 7)
    assert sorted(tuple(r)[1:] for r in graph_files.read_graph(spark, path).collect()) == sorted(tuple(r) for r in arcs.collect())
    vector = str(tmp_path / "pool.bin")
    graph_files.write_vector(vector, spark.createDataFrame([(1, 9), (0, 4)], "pool_idx long, node long"))
    assert [(r.pool_idx, r.node) for r in graph_files.read_vector(spark, vector).orderBy("pool_idx").collect()] == [(0, 4), (1, 9)]
    open(path, "wb").write(b"XXXX" + raw[4:])
    with pytest.raises(Exception, match="no graph file"):
        graph_files.read_graph(spark, path).collect()


def test_tables_of_text(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes("﻿school_id,lat,lon\n b ,1.5,2\na,, 3\na,2,1\na,1,9\n".encode())
    got = tables.read_facilities(spark, str(path))
    assert [tuple(r) for r in got.collect()] == [("a", 1.0, 9.0), ("a", 2.0, 1.0), ("b", 1.5, 2.0)]
    bad = spark.createDataFrame([("a", "x", "1")], "school_id string, lat string, lon string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.clean_facilities(bad, "school_id", "lat", "lon").collect()
    for name in ("small_dijkstra_k5", "small_bfs_k5", "small_dijkstra_k6"):
        (tmp_path / f"{name}.csv").write_text("qidx,node,school_idx,dist\n0,7,1,100\n")
    assert sorted((r.graph, r.k, r.alg) for r in tables.read_dumps(spark, str(tmp_path)).collect()) == [("small", 5, "bfs"), ("small", 5, "dijkstra")]
    assert tables.to_tex(["a", "b"], spark.createDataFrame([(1, "x")], "a int, b string"), "lr").splitlines()[4] == r"1 & x \\"


def test_numbers_as_text(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    values = [50.9845, 0.0005, 1.0005, 2.5, 0.0, 1e-9, 123456.7895] + [rnd.uniform(0, 1000) for _ in range(300)] + [k / 2000 for k in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", three_decimals(F.col("x")).alias("t")).collect()
    assert all(r.t == f"{r.x:.3f}" for r in rows)


def test_order_numbers(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "node long, v long"), ["v"], "rank", 8).collect()
    assert all(r["rank"] == r.v for r in got)
    assert morton_order(spark.createDataFrame([(5, 1.0, 1.0), (6, 1.0, 1.0)], "node long, lon double, lat double")).orderBy("rank").first().node == 5


def test_haversine(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first()
    assert math.isclose(row.d, 6371000 * math.pi / 180, rel_tol=1e-12)


@pytest.mark.parametrize("name", ["nearest_weighted", "verify_mismatch", "csr_rows", "oneway_expand", "snap_pool", "trial_summary", "main_table_pivot", "spearman_dist_hops"])
def test_queries_against_sql(spark, name):
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.sql(f"create view {file.split('.')[0]} as select * from '{sf}/{file}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    names = sorted(want.columns)
    got = __spark_entry__.queries()[name](spark, sf)
    assert sorted(got.columns) == names
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    order = [want.columns.index(c) for c in names]
    left = sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)
    right = sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=repr)
    assert left == right
