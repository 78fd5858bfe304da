"""From a street map and a list of facilities to a search graph and a facility pool."""

from __future__ import annotations

import csv
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwell.functions.geo import arc_weight, haversine, morton_order
from roadwell.operators.components import largest_component
from roadwell.operators.snap import facility_pool, nearest_node
from roadwell.operators.ways import CLASSES, class_filter, clip, crop, drop_invalid, expand, induced, renumber, segments
from roadwell.plans.nearest import transpose
from roadwell.sources.graph_files import write_graph, write_vector
from roadwell.sources.tables import sha256_of_files
from roadwell.storage import materialise


@dataclass
class Prepared:
    """nodes (node, lon, lat), search arcs (src, dst, w), pool and the counts of meta."""

    nodes: DataFrame
    arcs: DataFrame
    pool: DataFrame
    meta: dict


def prepare(
    ways: DataFrame, way_nodes: DataFrame, facilities: DataFrame, classes=CLASSES, ignore_oneway: bool = False,
    centre: tuple[float, float] = (-26.2041, 28.0473), target_nodes: int = 0, max_snap_m: float = 1000.0, bbox: tuple | None = None,
) -> Prepared:
    """Filter ways, cut them into arcs, weigh, crop, keep the largest strong component, order, snap.

    ways (way, highway, oneway, junction), way_nodes (way, pos, node, lon, lat), facilities
    (facility_id, lat, lon); centre is latitude and longitude.  Arcs are turned round, so that a
    search from facilities gives the way to them.
    """
    ways = class_filter(ways, classes)
    placed = drop_invalid(way_nodes.join(ways.select("way"), "way", "left_semi"))
    if bbox:
        placed = clip(placed, bbox)
    placed = materialise(placed, "prepare-nodes")
    nodes = materialise(placed.where("node IS NOT NULL").groupBy("node").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat")), "prepare-nodes")
    pairs = segments(placed.select("way", "pos", "node")).join(ways, "way").select("a", "b", "oneway", "junction")
    arcs = expand(pairs, ignore_oneway).select("src", "dst")
    end = lambda name, own: nodes.select(F.col("node").alias(name), F.col("lon").alias(f"lon_{own}"), F.col("lat").alias(f"lat_{own}"))
    arcs = arcs.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    metres = haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    arcs = materialise(arcs.select("src", "dst", arc_weight(metres).alias("w")), "prepare-arcs")
    raw_nodes = nodes.count()
    if target_nodes:
        nodes = materialise(crop(nodes, haversine(F.col("lon"), F.col("lat"), F.lit(centre[1]), F.lit(centre[0])), target_nodes), "prepare-nodes")
        arcs = materialise(induced(arcs, nodes), "prepare-arcs")
    kept = materialise(largest_component(nodes.select("node"), arcs), "prepare-kept")
    ordered = materialise(morton_order(nodes.join(kept, "node", "left_semi")).select("node", "lon", "lat", "rank"), "prepare-order")
    arcs = materialise(transpose(renumber(induced(arcs, kept), ordered.select("node", "rank"))), "prepare-search")
    nodes = ordered.select(F.col("rank").alias("node"), "lon", "lat")
    listed = materialise(facilities.withColumn("pid", F.monotonically_increasing_id()), "prepare-facilities")
    pool = materialise(facility_pool(nearest_node(listed, nodes), max_snap_m).drop("pid"), "prepare-pool")
    counts = meta_counts(nodes, arcs, raw_nodes, listed, pool)
    meta = counts | {
        "highways": ",".join(classes), "ignore_oneway": ignore_oneway, "centre": f"{centre[0]},{centre[1]}",
        "bbox": ",".join(map(str, bbox)) if bbox else None, "target_nodes": target_nodes, "max_snap_m": max_snap_m,
    }
    return Prepared(nodes, arcs, pool, meta)


def meta_counts(nodes: DataFrame, arcs: DataFrame, raw_nodes: int, listed: DataFrame, pool: DataFrame) -> dict:
    """What a prepared graph holds, and how many facilities were listed, kept and dropped."""
    listed_n, pool_n = listed.count(), pool.count()
    return {
        "nodes": nodes.count(), "edges": arcs.count(), "raw_nodes_in_extract": raw_nodes, "schools_in_list": listed_n,
        "schools_in_pool": pool_n, "schools_dropped_outside_graph_or_snap": listed_n - pool_n,
    }


def write_prepared(spark: SparkSession, found: Prepared, folder: str, map_file: str, facility_file: str) -> dict:
    """Writes graph.bin, nodes.csv, schools.bin, schools_map.csv and meta.json, and returns what meta.json holds.

    The formats are single files in node order; rows stream through the driver a partition at a time.
    """
    os.makedirs(folder, exist_ok=True)
    write_graph(os.path.join(folder, "graph.bin"), found.meta["nodes"], found.arcs)
    write_vector(os.path.join(folder, "schools.bin"), found.pool)
    with open(os.path.join(folder, "nodes.csv"), "w") as f:
        f.write("node,lon,lat\n")
        for row in found.nodes.select("node", "lon", "lat").orderBy("node").toLocalIterator():
            f.write(f"{row[0]},{row[1]:.7f},{row[2]:.7f}\n")
    with open(os.path.join(folder, "schools_map.csv"), "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["pool_idx", "school_id", "lat", "lon", "node", "snap_m"])
        for row in found.pool.select("pool_idx", "facility_id", "lat", "lon", "node", "snap_m").orderBy("pool_idx").toLocalIterator():
            out.writerow([*row[:5], f"{row[5]:.1f}"])
    meta = dict(found.meta)
    for key, path in (("pbf", map_file), ("schools", facility_file)):
        meta[f"{key}_file"] = os.path.basename(path)
        meta[f"{key}_sha256"] = sha256_of_files(spark, path).first()["sha256"]
    with open(os.path.join(folder, "meta.json"), "w") as f:
        json.dump(meta, f, indent=2)
    return meta
