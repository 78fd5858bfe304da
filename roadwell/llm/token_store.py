"""Operator 1: token ids in flat binary files with 64-bit document offsets.

``write_token_files`` deals documents out by ranges of their id, and each task streams its sorted
range into three flat files: ``.bin`` (unsigned 16- or 32-bit ids), ``.off`` (64-bit offsets, one
more than documents) and ``.doc`` (64-bit document ids).  A task names its files afresh, and only
those named in the manifest count, so a task that is run again leaves no mixture.  Prefix sums
over the manifest give each file its place in the whole; ``read_token_files`` maps the files into
memory and returns one row for each document.

Defined results: a null text is empty and has the end id alone; a null document id comes first;
rows that share an id follow each other in the order of their texts' hashes; other columns are
ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadwell.llm.files import map_array, write_bytes
from roadwell.llm.shared import materialise, ship, whole_text

#: Ids that a reader looks at together.
BLOCK = 1 << 21
MANIFEST = "partition int, docs long, nulls long, tokens long, wide boolean, stem string"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Writes all documents' ids under folder and returns the manifest with each file's base."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        from roadwell.llm.token_cache import encoder, runs_of

        encode = encoder(vocabulary)
        stem = f"{folder}/{uuid.uuid4().hex}"
        ids, lengths, nulls = [], [np.empty(0, np.int64)], 0

        def chunks():
            nonlocal nulls
            for batch in batches:
                ids.append(np.asarray(batch.column(0).fill_null(0)).astype("<i8"))
                nulls += batch.column(0).null_count
                for texts in runs_of(batch.column(1).to_pylist()):
                    found, counts = encode.flat(texts)
                    lengths.append(counts + 1)
                    yield np.insert(found, np.cumsum(counts), end_id).astype(encode.dtype)

        write_bytes(f"{stem}.bin", chunks())
        lengths = np.concatenate(lengths)
        if not len(lengths):
            return
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        write_bytes(f"{stem}.off", [offsets.tobytes()])
        write_bytes(f"{stem}.doc", [np.concatenate(ids).tobytes()])
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "partition": TaskContext.get().partitionId(),
                    "docs": len(lengths),
                    "nulls": nulls,
                    "tokens": int(offsets[-1]),
                    "wide": encode.dtype.itemsize == 4,
                    "stem": stem,
                }
            ],
            pa.schema(
                [
                    ("partition", pa.int32()),
                    ("docs", pa.int64()),
                    ("nulls", pa.int64()),
                    ("tokens", pa.int64()),
                    ("wide", pa.bool_()),
                    ("stem", pa.string()),
                ]
            ),
        )

    rows = (
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    manifest = materialise(rows.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document: its first id's place in the whole, its ids' number and checksum."""
    spark = manifest.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = map_array(f"{row['stem']}.bin", "<u4" if row["wide"] else "<u2")
                offsets = np.asarray(map_array(f"{row['stem']}.off", "<i8")[:])
                docs = np.asarray(map_array(f"{row['stem']}.doc", "<i8")[:])
                lo = 0
                while lo < len(docs):
                    # documents of about BLOCK ids at once, one at least
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
                    block = memoryview(np.asarray(tokens[int(offsets[lo]) : int(offsets[hi])]).astype("<u4")).cast("B")
                    ends = (4 * (offsets[lo : hi + 1] - offsets[lo])).tolist()
                    crc = [zlib.crc32(block[a:b]) for a, b in zip(ends, ends[1:])]
                    known = np.arange(lo, hi) >= row["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[lo:hi], pa.int64(), mask=~known),
                            pa.array(row["base"] + offsets[lo:hi], pa.int64()),
                            pa.array(np.diff(offsets[lo : hi + 1]), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    lo = hi

    return manifest.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
