"""Operator 8: best-fit packing of token sequences by hierarchical residual packing.

Each task encodes its documents, cuts those longer than a sequence and packs the pieces best-fit,
longest first.  Bins that are nearly full are done.  The others are items of the next round: tasks
fewer and fewer in number pack them the same way, until one round has few enough for one task or
brings nothing more.  Only bins move between rounds, never pieces or texts.

Defined results: a null text is empty and one end id long; repeated rows are packed each for
itself; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwell.llm.shared import materialise, ship, whole_text

SIZE = 2048
#: Free places that a bin may have and count as nearly full.
SPARE = 2
#: Pieces that a task packs at once, and bins that a task of a later round gets on average.
HELD = 200_000
GROUP = 16_384
FAN_IN = 8


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin of each item, its offset there, fill of each bin).

    Bins are kept by the places they have left; a bit mask finds the fullest one that fits.
    """
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    by_left: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        fitting = mask >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            chosen = by_left[left].pop()
            if not by_left[left]:
                mask ^= 1 << left
        else:
            left, chosen = size, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += need
        left -= need
        if left:
            by_left[left].append(chosen)
            mask |= 1 << left
    return bins, offsets, fills


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
TYPES = [pa.int64(), pa.int32()] + [pa.int64()] * 6


def local_bins(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """The pieces of all documents, each task's packed into bins of its own."""
    ship(docs.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        from roadwell.llm.token_cache import encoder, runs_of

        encode = encoder(vocabulary)
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def flush():
            nonlocal rows, first
            bins, offsets, fills = best_fit([r[3] for r in rows], size)
            columns = [list(c) for c in zip(*rows)]
            columns += [[first + b for b in bins], offsets, [fills[b] for b in bins]]
            first += len(fills)
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], names)

        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for texts in runs_of(batch.column(1).to_pylist()):
                found, counts = encode.flat(texts)
                held = memoryview(np.insert(found.astype("<u4"), np.cumsum(counts), end_id).astype("<u4")).cast("B")
                at = 0
                for doc, n in zip(islice(ids, len(texts)), (counts + 1).tolist()):
                    for piece, start in enumerate(range(0, n, size)):
                        length = min(size, n - start)
                        rows.append((doc, piece, start, length, zlib.crc32(held[at + 4 * start : at + 4 * (start + length)])))
                    at += 4 * n
                if len(rows) >= HELD:
                    yield flush()
        if rows:
            yield flush()

    columns = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return columns.mapInArrow(pack, PIECES)


def merge_round(bins: DataFrame, groups: int, turn: int, size: int) -> DataFrame:
    """(bin, target, shift, fill): where each bin goes when groups tasks pack them anew."""

    def pack(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, lengths = table.column(0).to_pylist(), table.column(1).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-lengths[i], ids[i]))
        ids, lengths = [ids[i] for i in order], [lengths[i] for i in order]
        chosen, shifts, fills = best_fit(lengths, size)
        name: dict[int, int] = {}
        for own, b in zip(ids, chosen):
            name.setdefault(b, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (ids, [name[b] for b in chosen], shifts, [fills[b] for b in chosen])],
            ["bin", "target", "shift", "fill"],
        )

    dealt = bins.select("bin", "fill").repartition(groups, F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
    return dealt.mapInArrow(pack, "bin long, target long, shift long, fill long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece."""
    pieces = materialise(local_bins(docs, vocabulary, end_id, size), "packing-pieces")
    loose = pieces.where((F.col("fill") < size - SPARE) & (F.col("offset") == 0))
    # (bin, target, shift, fill): bin has gone into target, at shift
    moves = loose.select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"), "fill")
    moves = materialise(moves, "packing-bins")
    n = moves.count()
    groups = max(1, -(-pieces.rdd.getNumPartitions() // FAN_IN), -(-n // GROUP))
    turn = 0
    while n > 1:
        turn += 1
        roots = moves.where((F.col("bin") == F.col("target")) & (F.col("fill") < size - SPARE))
        step = merge_round(roots, groups, turn, size).select(
            F.col("bin").alias("_bin"), F.col("target").alias("_to"), F.col("shift").alias("_by"), F.col("fill").alias("_fill")
        )
        moves = materialise(
            moves.join(step, F.col("target") == F.col("_bin"), "left").select(
                "bin",
                F.coalesce("_to", "target").alias("target"),
                (F.col("shift") + F.coalesce("_by", F.lit(0))).alias("shift"),
                F.coalesce("_fill", "fill").alias("fill"),
            ),
            "packing-bins",
        )
        left = moves.where((F.col("bin") == F.col("target")) & (F.col("fill") < size - SPARE)).count()
        few = max(1, -(-left // GROUP))
        if groups == 1 or groups <= few and left > 0.98 * n:
            break
        n, groups = left, max(few, -(-groups // FAN_IN))
    moved = moves.where((F.col("bin") != F.col("target")) | (F.col("shift") != 0))
    moved = moved.select(F.col("bin").alias("_bin"), "target", "shift")
    placed = pieces.join(moved, F.col("bin") == F.col("_bin"), "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
