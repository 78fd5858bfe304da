"""Each point's nearest node, exactly, by grid cells of growing size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwell.functions.geo import haversine
from roadwell.storage import materialise


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points (pid, lon, lat) with node and snap_m of the nearest of nodes (node, lon, lat).

    Nearest in the plane of latitude and longitude times the cosine of the nodes' mean latitude;
    of equals the lowest node.  A point is compared with nodes of its cell and the eight around
    it.  What lies within one cell's width is nearest for certain; points with nothing so near go
    into the next round, of cells twice as wide.
    """
    box = nodes.agg(F.count("*"), F.avg("lat"), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    n, mean = box[0], box[1]
    if not n:
        return points.select("*", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("snap_m"))
    scale = math.cos(math.radians(mean))
    ends = points.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if ends[0] is None:
        return points.select("*", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("snap_m"))
    tall = max(box[3], ends[1]) - min(box[2], ends[0])
    wide = (max(box[5], ends[3]) - min(box[4], ends[2])) * scale
    extent = max(tall, wide, 1e-9)
    size = 2 * extent / math.sqrt(n)
    places = nodes.select(F.col("node").cast("long"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), (F.col("lon") * scale).alias("_x"), F.col("lat").alias("_y"))
    left = materialise(points.select("*", (F.col("lon") * scale).alias("_px"), F.col("lat").alias("_py")), "snap")
    done = None
    while True:
        cell = lambda v: F.floor(F.col(v) / size)  # noqa: E731, B023
        around = F.array(*[F.struct((cell("_px") + i).alias("cx"), (cell("_py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        asked = left.withColumn("_c", F.explode(around)).select(*left.columns, "_c.cx", "_c.cy")
        offered = places.select("*", cell("_x").alias("cx"), cell("_y").alias("cy"))
        dx, dy = F.col("_px") - F.col("_x"), F.col("_py") - F.col("_y")
        best = asked.join(offered, ["cx", "cy"]).groupBy("pid").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "node", "_lon", "_lat")).alias("best"))
        met = left.join(best, "pid", "left")
        last = size > extent
        sure = F.col("best").isNotNull() & (F.lit(last) | (F.col("best.d2") <= size * size))
        met = materialise(met.withColumn("_sure", F.coalesce(sure, F.lit(False))), "snap")
        found = met.where("_sure").select(
            *points.columns, F.col("best.node").alias("node"),
            haversine(F.col("best._lon"), F.col("best._lat"), F.col("lon"), F.col("lat")).alias("snap_m"),
        )
        done = found if done is None else done.unionByName(found)
        left = met.where("NOT _sure").select(*left.columns)
        if last or left.isEmpty():
            return done
        size *= 2


def facility_pool(snapped: DataFrame, most: float = 1000.0) -> DataFrame:
    """Facilities snapped within most metres, numbered from 0 by id, latitude and longitude."""
    from roadwell.functions.geo import numbered

    return numbered(snapped.where(F.col("snap_m") <= most), ["facility_id", "lat", "lon"], "pool_idx")
