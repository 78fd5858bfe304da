"""Texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash, whose fingerprints of the same shingles link within a radius, and for
what no radius holds from MinHash: ``BANDS`` keys of ``ROWS`` minima each, of which two texts at 0.8 share
at least one but for a chance of 2 in 10^8, and nearer ones all the more.  What candidates join is a
group; every pair of a group that is not joined yet is compared by its whole sets, so links are exact.
A group beyond ``BLOCK`` texts is compared block against block in tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwell.llm.shared import ship, whole_text

WIDTH = 5
#: Similarity as a fraction: ALIKE[0] / ALIKE[1].
ALIKE = (4, 5)
BANDS, ROWS = 45, 5
#: Texts of a group that one task compares with each other.
BLOCK = 512

_RNG = np.random.default_rng(20_26)
_MASKS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(words: list[bytes], digest) -> np.ndarray:
    """The hashes of a text's shingles, sorted and each once; a shorter text is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - WIDTH + 1)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    return np.unique(np.array([digest(text[a:b], 42) for a, b in zip(begins, ends[-n:].tolist())], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys under which a set of shingles meets those like it."""
    if not len(found):
        return np.empty(0, np.int64)
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(short), 1024):
        least = np.minimum(least, ((short[lo : lo + 1024] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(1))
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64) ^ _BAND
    return mixed.view(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint: a bit is set where over half of the hashes have it; zero for none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _words(text: bytes) -> list[bytes]:
    # bytes.lower() and bytes.split() know ASCII alone, as in the fingerprints
    return text.lower().split()


def add_sketches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep with key, a hash of the words in order, the fingerprint fp and the keys of the bands."""
    ship(docs.sparkSession)

    def make(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            keys, prints, found = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = _words(text)
                keys.append(xxh64_intdigest(b" ".join(words), 7))
                own = shingles(words, xxh64_intdigest)
                prints.append(majority(own))
                found.append(bands(own))
            own = [batch.column(k) for k in range(len(keep))]
            keys, prints = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, prints))
            yield pa.RecordBatch.from_arrays([*own, keys, prints, pa.array(found, pa.list_(pa.int64()))], [*keep, "key", "fp", "bands"])

    held = docs.select(*keep, F.encode(whole_text(), "utf-8").alias("raw"))
    schema = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in keep)
    return held.mapInArrow(make, f"{schema}, key long, fp long, bands array<long>")


def candidates(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that join all keys sharing a band: each band's keys with its least one."""
    dealt = texts.select("key", F.explode("bands").alias("band"))
    crowds = dealt.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("last")).where("b <> last")
    return dealt.join(crowds.select("band", "b"), "band").where("key <> b").select(F.col("key").alias("a"), "b").distinct()


def joined_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places, one of left and one of right, that join all whose sets are alike."""
    top, bottom = ALIKE
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    flat = np.concatenate([sets[m] for m in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(right)), sizes[right])[order]
    links = []
    for q in left.tolist():
        apart = root[right] != root[q]
        if not apart.any():
            continue
        lo, hi = np.searchsorted(flat, sets[q], "left"), np.searchsorted(flat, sets[q], "right")
        n = hi - lo
        places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[places], minlength=len(right))
        # shared / (sizes together - shared) reaches the similarity
        alike = apart & ((top + bottom) * shared >= top * (sizes[q] + sizes[right]))
        for m in right[alike].tolist():
            if root[m] != root[q]:
                links.append((q, m))
                root[root == root[m]] = root[q]
    return links


def alike(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that together join all alike, for texts with key, label and text.

    Only texts of one label are compared; a key stands once.
    """
    spark = texts.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = [shingles(_words(t), xxh64_intdigest).view(np.int64) for t in batch.column(3).to_pylist()]
            own = [batch.column(k) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.list_(pa.int64()))], ["key", "label", "pieces", "found"])

    held = texts.select("key", "label", "pieces", F.encode(whole_text(), "utf-8").alias("raw"))
    sets = held.mapInArrow(read, "key long, label long, pieces int, found array<long>")
    # a group of p blocks has a task for each pair of blocks; a text of block i goes to i's pairs
    own = F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")),
    )
    dealt = sets.select("label", "key", own.alias("block"), "found", F.explode(pairs).alias("pair"))
    dealt = dealt.select("label", "pair.i", "pair.j", "block", "key", "found")
    dealt = dealt.repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j")

    def compare(batches):
        def solve(rows, i, j):
            keys = [r[1] for r in rows]
            found = [r[2] for r in rows]
            block = np.array([r[0] for r in rows])
            left = right = np.arange(len(rows))
            if i != j:
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if len(left) and len(right):
                for a, b in joined_sets(found, left, right):
                    yield keys[a], keys[b]

        def groups():
            at, rows = None, []
            for batch in batches:
                head = [batch.column(k).to_pylist() for k in range(5)]
                flat = batch.column(5)
                values, offsets = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy()
                for k, (label, i, j, block, key) in enumerate(zip(*head)):
                    if (label, i, j) != at:
                        if rows:
                            yield from solve(rows, *at[1:])
                        at, rows = (label, i, j), []
                    rows.append((block, key, values[offsets[k] : offsets[k + 1]]))
            if rows:
                yield from solve(rows, *at[1:])

        out = []
        for link in groups():
            out.append(link)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")
