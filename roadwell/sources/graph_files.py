"""Binary graph and vector files: little-endian unsigned 32-bit numbers.

A graph file is the four letters NSG1, n, m, xadj[n + 1], adj[m] and w[m]; a vector file is its
length and its numbers.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwell.operators.partition import degrees
from roadwell.shipping import ship

MAGIC = b"NSG1"


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(path, src, dst, w) of each graph file that path names."""
    ship(spark)

    def decode(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                if raw[:4] != MAGIC:
                    raise ValueError(f"{name} is no graph file")
                n, m = struct.unpack_from("<II", raw, 4)
                if len(raw) < 12 + 4 * (n + 1 + 2 * m):
                    raise ValueError(f"{name} is cut off")
                numbers = np.frombuffer(raw, "<u4", n + 1 + 2 * m, 12).astype(np.int64)
                src = np.repeat(np.arange(n), np.diff(numbers[: n + 1]))
                for lo in range(0, m, 1 << 20):
                    part = slice(lo, lo + (1 << 20))
                    yield pd.DataFrame({"path": name, "src": src[part], "dst": numbers[n + 1 : n + 1 + m][part], "w": numbers[n + 1 + m :][part]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, src long, dst long, w long")


def graph_sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """The numbers of nodes and arcs that a graph file names in its head."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 12).alias("head")).first()["head"]
    if bytes(head[:4]) != MAGIC:
        raise ValueError(f"{path} is no graph file")
    return struct.unpack_from("<II", head, 4)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(path, pool_idx, node) of each vector file that path names."""
    ship(spark)

    def decode(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                (n,) = struct.unpack_from("<I", raw, 0)
                if len(raw) < 4 + 4 * n:
                    raise ValueError(f"{name} is cut off")
                yield pd.DataFrame({"path": name, "pool_idx": np.arange(n), "node": np.frombuffer(raw, "<u4", n, 4).astype(np.int64)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, pool_idx long, node long")


def write_graph(path: str, n: int, arcs: DataFrame) -> None:
    """The graph as one file; arcs of a node stand by dst and w.

    The format is one file in node order, so sorted rows stream through the driver, a partition at a
    time, into the three runs of numbers.
    """
    m = arcs.count()
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<II", n, m))
        for row in degrees(n, arcs).orderBy("node").select("xadj").toLocalIterator():
            f.write(struct.pack("<I", row[0]))
        f.write(struct.pack("<I", m))
        ordered = arcs.orderBy("src", "dst", "w")
        for column in ("dst", "w"):
            for row in ordered.select("src", "dst", "w").toLocalIterator():
                f.write(struct.pack("<I", row[column]))


def write_vector(path: str, rows: DataFrame) -> None:
    """The nodes of (pool_idx, node) in the order of pool_idx."""
    n = rows.count()
    with open(path, "wb") as f:
        f.write(struct.pack("<I", n))
        for row in rows.orderBy("pool_idx").select(F.col("node")).toLocalIterator():
            f.write(struct.pack("<I", row[0]))
