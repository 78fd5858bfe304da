"""Street maps: ways with their nodes' places, from OSM XML or from protocol-buffer files (PBF)."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwell.shipping import ship

NODE = "_id LONG, _lat DOUBLE, _lon DOUBLE"
WAY = "_id LONG, nd ARRAY<STRUCT<_ref: LONG>>, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
TAGS = ("highway", "oneway", "junction")


def _joined(ways: DataFrame, refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways with a highway tag, their nodes in order); a node that the file does not place has null coordinates."""
    ways = ways.where("highway IS NOT NULL")
    kept = refs.join(ways.select("way"), "way", "left_semi")
    return ways, kept.join(nodes, "node", "left").select("way", "pos", "node", "lon", "lat")


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ways (way, highway, oneway, junction) and way nodes (way, pos, node, lon, lat) of an OSM XML file."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", NODE).select(F.col("_id").alias("node"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    raw = read("way", WAY)
    value = lambda k: F.get(F.transform(F.filter("tag", lambda t: t["_k"] == k), lambda t: t["_v"]), F.lit(0)).alias(k)
    ways = raw.select(F.col("_id").alias("way"), *[value(k) for k in TAGS])
    refs = raw.select(F.col("_id").alias("way"), F.posexplode("nd").alias("pos", "nd")).select("way", "pos", F.col("nd._ref").alias("node"))
    return _joined(ways, refs, nodes)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(raw: bytes):
    """(number, value) of a message; lengths give bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in a PBF message")
        yield key >> 3, value


def _numbers(raw: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        value, at = _varint(raw, at)
        out.append((value >> 1) ^ -(value & 1) if signed else value)
    return out


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blobs(raw: bytes):
    """(kind, content) of the blobs of a PBF file."""
    at = 0
    while at < len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        head = dict(_fields(raw[at + 4 : at + 4 + size]))
        at += 4 + size
        body = dict(_fields(raw[at : at + head[3]]))
        at += head[3]
        if 1 in body:
            content = body[1]
        elif 3 in body:
            content = zlib.decompress(body[3])
        else:
            raise ValueError("a PBF blob is neither plain nor zlib")
        yield head[1].decode(), content


def decode_block(content: bytes) -> tuple[list[tuple], list[tuple]]:
    """Nodes (id, lon, lat) and ways (id, refs, tags) of a primitive block."""
    fields = list(_fields(content))
    top = dict(fields)
    strings = [v.decode("utf-8") for n, v in _fields(top.get(1, b"")) if n == 1]
    step, lat_off, lon_off = top.get(17, 100), top.get(19, 0), top.get(20, 0)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    place = lambda off, v: (signed(off) + step * v) / 1e9
    nodes, ways = [], []
    for number, group in fields:
        if number != 2:
            continue
        for kind, raw in _fields(group):
            own = dict(_fields(raw))
            if kind == 1:
                zig = lambda v: (v >> 1) ^ -(v & 1)
                nodes.append((zig(own[1]), place(lon_off, zig(own[9])), place(lat_off, zig(own[8]))))
            elif kind == 2:
                ids, lats, lons = (_running(_numbers(own.get(k, b""), True)) for k in (1, 8, 9))
                nodes += [(i, place(lon_off, x), place(lat_off, y)) for i, y, x in zip(ids, lats, lons)]
            elif kind == 3:
                tags = {strings[k]: strings[v] for k, v in zip(_numbers(own.get(2, b"")), _numbers(own.get(3, b"")))}
                ways.append((own[1], _running(_numbers(own.get(8, b""), True)), tags))
    return nodes, ways


def read_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same as read_xml for PBF files: a file's blobs are decoded where they are dealt to."""
    ship(spark)

    def split(frames):
        for frame in frames:
            for raw in frame["content"]:
                for kind, content in blobs(raw):
                    if kind == "OSMData":
                        yield pd.DataFrame({"block": [content]})

    def nodes_of(frames):
        for frame in frames:
            for block in frame["block"]:
                yield pd.DataFrame(decode_block(block)[0], columns=["node", "lon", "lat"])

    def ways_of(frames):
        for frame in frames:
            for block in frame["block"]:
                rows = [(i, refs, *[tags.get(k) for k in TAGS]) for i, refs, tags in decode_block(block)[1]]
                yield pd.DataFrame(rows, columns=["way", "refs", *TAGS])

    from roadwell.storage import materialise

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").load(path).select("content")
    held = materialise(files.mapInPandas(split, "block binary").repartition(n), "pbf")
    nodes = held.mapInPandas(nodes_of, "node long, lon double, lat double")
    raw = held.mapInPandas(ways_of, "way long, refs array<long>, highway string, oneway string, junction string")
    refs = raw.select("way", F.posexplode("refs").alias("pos", "node"))
    return _joined(raw.drop("refs"), refs, nodes)
