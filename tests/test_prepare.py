"""A 25 by 25 street grid, as XML and as PBF, prepared and searched, against plain Python."""

import heapq
import math
import random
import struct
import zlib

import pytest

from roadwell.plans.nearest import nearest_facility
from roadwell.plans.prepare import prepare
from roadwell.sources import osm

SIDE, LON, LAT, STEP = 25, 28.0, -26.2, 0.001


def name(r, c):
    return 1 + r * SIDE + c


def streets():
    """(id, refs, tags): rows, every fourth of them one-way, columns, and a footway across."""
    out = []
    for r in range(SIDE):
        tags = {"highway": "residential"} | ({"oneway": "yes"} if r % 4 == 1 else {})
        out.append((1000 + r, [name(r, c) for c in range(SIDE)], tags))
    out += [(2000 + c, [name(r, c) for r in range(SIDE)], {"highway": "residential"}) for c in range(SIDE)]
    return [*out, (3000, [name(k, k) for k in range(SIDE)], {"highway": "footway"})]


def place(i):
    r, c = divmod(i - 1, SIDE)
    return LON + c * STEP, LAT + r * STEP


def write_xml(path):
    nodes = "".join(f'<node id="{i}" lat="{place(i)[1]:.7f}" lon="{place(i)[0]:.7f}"/>\n' for i in range(1, SIDE * SIDE + 1))
    way = lambda i, refs, tags: f'<way id="{i}">' + "".join(f'<nd ref="{x}"/>' for x in refs) + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags.items()) + "</way>\n"
    path.write_text('<?xml version="1.0"?><osm>' + nodes + "".join(way(*w) for w in streets()) + "</osm>")


def varint(v):
    out = b""
    while v >= 0x80:
        out, v = out + bytes([v & 0x7F | 0x80]), v >> 7
    return out + bytes([v])


def field(n, v):
    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


def zigzag(v):
    return varint(v << 1 if v >= 0 else (-v << 1) - 1)


def steps(values):
    return b"".join(zigzag(b - a) for a, b in zip([0, *values], values))


def write_pbf(path):
    strings = ["", "highway", "residential", "footway", "oneway", "yes"]
    ids = list(range(1, SIDE * SIDE + 1))
    unit = lambda v: round(v * 1e7)
    dense = field(1, steps(ids)) + field(8, steps([unit(place(i)[1]) for i in ids])) + field(9, steps([unit(place(i)[0]) for i in ids]))
    number = strings.index
    way = lambda i, refs, tags: field(1, i) + field(2, b"".join(varint(number(k)) for k in tags)) + field(3, b"".join(varint(number(v)) for v in tags.values())) + field(8, steps(refs))
    table = field(1, b"".join(field(1, s.encode()) for s in strings))
    blocks = [table + field(2, field(2, dense)), table + field(2, b"".join(field(3, way(*w)) for w in streets()))]
    with open(path, "wb") as f:
        for kind, content in [(b"OSMHeader", b""), *((b"OSMData", b) for b in blocks)]:
            blob = field(2, len(content)) + field(3, zlib.compress(content))
            head = field(1, kind) + field(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)


def metres(a, b):
    (x, y), (u, v) = place(a), place(b)
    p, q = math.radians(y), math.radians(v)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(u - x) / 2) ** 2
    return max(1, round(2 * 6371000 * math.asin(math.sqrt(h))))


@pytest.mark.parametrize("kind", ["xml", "pbf"])
def test_grid_end_to_end(spark, tmp_path, kind):
    path = tmp_path / f"grid.{kind}"
    (write_xml if kind == "xml" else write_pbf)(path)
    ways, way_nodes = (osm.read_xml if kind == "xml" else osm.read_pbf)(spark, str(path))
    rnd = random.Random(1)
    listed = [(f"S{k:03d}", LAT + rnd.random() * 24 * STEP, LON + rnd.random() * 24 * STEP) for k in range(12)] + [("far", 0.0, 0.0)]
    out = prepare(ways, way_nodes, spark.createDataFrame(listed, "facility_id string, lat double, lon double"))
    assert out.meta["nodes"] == SIDE * SIDE and out.meta["schools_in_pool"] == 12 and out.meta["schools_dropped_outside_graph_or_snap"] == 1
    old = {}
    for r in out.nodes.collect():
        old[r.node] = name(round((r.lat - LAT) / STEP), round((r.lon - LON) / STEP))
    assert sorted(old) == list(range(SIDE * SIDE)) and len(set(old.values())) == len(old)
    travel = {}
    for _, refs, tags in streets()[:-1]:
        for a, b in zip(refs, refs[1:]):
            travel.setdefault(a, []).append(b)
            if tags.get("oneway") != "yes":
                travel.setdefault(b, []).append(a)
    pool = out.pool.orderBy("pool_idx").collect()
    assert [r.facility_id for r in pool] == [f"S{k:03d}" for k in range(12)]
    back = {}
    for a, to in travel.items():
        for b in to:
            back.setdefault(b, []).append(a)
    for metric in ("weighted", "hops"):
        best, heap = {}, sorted((0, r.pool_idx, old[r.node]) for r in pool)
        while heap:
            d, f, n = heapq.heappop(heap)
            if n not in best:
                best[n] = (d, f)
                for m in back.get(n, ()):
                    heapq.heappush(heap, (d + (metres(m, n) if metric == "weighted" else 1), f, m))
        scenario = out.pool.selectExpr("0 AS scenario", "pool_idx AS pos", "pool_idx")
        origins = out.nodes.selectExpr("node AS qidx", "node")
        got = nearest_facility(out.arcs, out.pool.select("pool_idx", "node"), scenario, origins, metric, "scenario").collect()
        assert {old[r.node]: (r.dist, r.pool_idx) for r in got} == best


def test_crop_and_box(spark, tmp_path):
    path = tmp_path / "grid.xml"
    write_xml(path)
    ways, way_nodes = osm.read_xml(spark, str(path))
    none = spark.createDataFrame([], "facility_id string, lat double, lon double")
    small = prepare(ways, way_nodes, none, centre=(LAT + 12 * STEP, LON + 12 * STEP), target_nodes=50)
    assert 45 <= small.meta["nodes"] <= 60 and small.meta["raw_nodes_in_extract"] == SIDE * SIDE and small.meta["schools_in_pool"] == 0
    boxed = prepare(ways, way_nodes, none, bbox=(LON - STEP / 2, LAT - STEP / 2, LON + 4.5 * STEP, LAT + 9.5 * STEP), ignore_oneway=True)
    assert boxed.meta["nodes"] == 50 and boxed.meta["edges"] == 2 * (4 * 10 + 9 * 5)
