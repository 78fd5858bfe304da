"""Operator 3: SimHash near-duplicates.

A text's fingerprint has a bit set where over half of the hashes of its word shingles have it.
Two fingerprints link where at most ``radius`` bits differ.  The 64 bits are cut into blocks, of
which two such fingerprints share at least all but ``radius``; so each fingerprint goes into one
bucket for every choice of that many blocks, and only fingerprints of one bucket are compared.
Inside a bucket the bits stand in vertical planes: XOR with a plane updates the distances of all
its members at once in carry-save counters, and a block of members is left as soon as every
distance exceeds the radius.

Exact copies are one fingerprint before any comparison.  A bucket gives a forest of links, never
all its pairs; buckets beyond ``BLOCK`` members are dealt out by half of the bits they do not share.  Components come from alternating large-star and small-star rounds over written tables.

Defined results: null, empty and blank texts have the fingerprint zero and link like any other;
a null doc_id is never a component's id unless all of it are null; repeated rows each keep their
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwell.llm import shingles
from roadwell.llm.shared import drop, materialise, ship, whole_text

#: Members of a bucket that one task compares with each other; larger buckets are dealt out by more bits.
BLOCK = 4096
#: Runs into which free bits are cut, and the most bits by which a pair that shares half of the runs may differ.
PARTS, MOST = 4, 2
#: Rows that may be broadcast.
SMALL = 1_000_000


def fingerprint(words: list[bytes], width: int, digest) -> int:
    """The fingerprint of a text's words."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    hashes = np.array([digest(text[a:b], 42) for a, b in zip(begins, ends)], np.uint64)
    return shingles.majority(hashes)


def add_fingerprints(docs: DataFrame, keep: list[str], width: int) -> DataFrame:
    """The columns of keep with the fingerprint fp of the whole text, a signed 64-bit number."""
    ship(docs.sparkSession)

    def make(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            # bytes.lower() and bytes.split() know ASCII alone: A-Z, and U+0009 to U+000D with the space
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = np.array([fingerprint(t.lower().split(), width, xxh64_intdigest) for t in texts], np.uint64)
            own = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found.view(np.int64))], [*keep, "fp"])

    held = docs.select(*keep, F.encode(whole_text(), "utf-8").alias("raw"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return held.mapInArrow(make, f"{schema}, fp long")


def planes(members: np.ndarray) -> np.ndarray:
    """64 rows of bits: row b holds bit b of every member, eight members to a byte."""
    bits = np.unpackbits(members.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def within(queries: np.ndarray, members: np.ndarray, radius: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) whose values differ in at most radius (0 to 3) bits.

    Two carry-save planes hold each distance modulo four and a third whether it ever got there.
    """
    found_q, found_m = [], []
    for lo in range(0, len(members), 8 * block):
        vertical = planes(members[lo : lo + 8 * block])
        for q0 in range(0, len(queries), 256):
            alive = np.arange(q0, min(q0 + 256, len(queries)))
            some = queries[alive]
            ones = np.zeros((len(alive), vertical.shape[1]), np.uint8)
            twos, over = ones.copy(), ones.copy()
            for bit in range(64):
                flip = ((some >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8) * np.uint8(255)
                differ = vertical[bit] ^ flip[:, None]
                carry = ones & differ
                ones ^= differ
                over |= twos & carry
                twos ^= carry
                if bit % 8 == 7:
                    # what is beyond the radius already: the overflow, or the counters' value
                    beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones if radius == 0 else over)
                    left = (beyond != 255).any(1)
                    if not left.any():
                        alive = alive[:0]
                        break
                    if not left.all():
                        alive, some, ones, twos, over = alive[left], some[left], ones[left], twos[left], over[left]
            if len(alive):
                beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones if radius == 0 else over)
                hits = np.unpackbits(~beyond, axis=1, bitorder="little")[:, : min(8 * block, len(members) - lo)]
                q, m = np.nonzero(hits)
                found_q.append(alive[q])
                found_m.append(m + lo)
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_m)


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is linked between two lists of values, fewer than there are values."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for at in range(0, len(left), 512):
        q, m = within(left[at : at + 512], right, radius)
        for a, b in zip(left[q + at].view(np.int64).tolist(), right[m].view(np.int64).tolist()):
            if a != b and (ra := root(a)) != (rb := root(b)):
                parent[max(ra, rb)] = min(ra, rb)
                links.append((a, b))
    return links


def small_links(keys: np.ndarray, values: np.ndarray, most: int, radius: int) -> tuple[list, list, np.ndarray]:
    """Links inside buckets of at most ``most`` members, all buckets of a batch at once.

    keys are sorted.  Member i is compared with member i + lag for each lag, and the batch's
    differences stand in bit planes as in ``within``.  Also returns where larger buckets lie.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    ends = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= most, sizes)
    out_a, out_b = [], []
    at = np.arange(len(keys))
    for lag in range(1, most):
        i = at[small & (at + lag < ends)]
        if not len(i):
            break
        differ = values[i] ^ values[i + lag]
        for lo in range(0, len(i), 1 << 15):
            some = differ[lo : lo + (1 << 15)]
            hit = within(np.zeros(1, np.uint64), some, radius, block=512)[1] + lo
            out_a.append(values[i[hit]])
            out_b.append(values[i[hit] + lag])
    return out_a, out_b, np.flatnonzero(sizes > most)


def halved(free: int) -> list[int]:
    """Masks of half of the free bits each: all choices of two of four runs of them.

    Values that agree elsewhere and differ in at most two bits agree on one of the choices.
    """
    places = [b for b in range(64) if free >> b & 1]
    wide = len(places) // PARTS
    runs = [sum(1 << b for b in places[k * wide : (k + 1) * wide]) for k in range(PARTS)]
    return [a | b for a, b in combinations(runs, PARTS - MOST)]


def finer(masks: list[int]) -> dict[int, list[int]]:
    """For each mask of agreeing bits those that add half of the others, as signed numbers."""
    return {m: [_signed(m | more) for more in halved(~m & (1 << 64) - 1)] for m in masks}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def in_bucket(dealt: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) that join all linked fingerprints of each bucket (mask, bits)."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        held = None

        def solve(group: pa.Table):
            mask, bits, fp = (group.column(c).to_numpy() for c in range(3))
            value = np.ascontiguousarray(fp).view(np.uint64)
            ids = np.cumsum(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]))
            a, b, large = small_links(ids, value, 48, radius)
            if a:
                yield np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            for k in large:
                own = value[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(ids)]
                links = forest(own, own, radius)
                if links:
                    yield np.array([x for x, _ in links]), np.array([y for _, y in links])

        def emit(group):
            for a, b in solve(group):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            last = [held.column(c)[-1].as_py() for c in range(2)]
            same = np.logical_and.reduce([held.column(c).to_numpy() == last[c] for c in range(2)])
            cut = int(np.argmax(same))  # whole buckets lie before
            if cut:
                yield from emit(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from emit(held.combine_chunks())

    dealt = dealt.select("mask", "bits", "fp").repartition(n, "mask", "bits").sortWithinPartitions("mask", "bits")
    return dealt.mapInArrow(compare, "a long, b long")


def links_between(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of different fingerprints that together join all that are linked; prints has distinct values in fp.

    Fingerprints meet in buckets of 32 bits that they share.  A bucket with more than BLOCK members
    is dealt out again by half of its other bits, and those by half of theirs; 56 shared bits leave
    at most 256 members.
    """
    if radius > MOST:
        raise ValueError(f"buckets hold pairs within {MOST} bits")
    spark = prints.sparkSession
    ship(spark)
    masks = halved((1 << 64) - 1)
    keys = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.mask", "key.bits", "fp")
    links = None
    for level in range(3):
        if level < 2:
            crowds = rows.groupBy("mask", "bits").count().where(F.col("count") > BLOCK).select("mask", "bits", F.lit(True).alias("crowd"))
            crowds = materialise(crowds, "simhash-crowds")
            # a crowd has more than BLOCK rows, so there are few; beyond SMALL the join is dealt out like any other
            many = crowds.count()
            rows = rows.join(F.broadcast(crowds) if many <= SMALL else crowds, ["mask", "bits"], "left")
        else:
            rows, many = rows.withColumn("crowd", F.lit(None).cast("boolean")), 0
        found = in_bucket(rows.where("crowd IS NULL"), radius)
        links = found if links is None else links.unionByName(found)
        if not many:
            return links
        below = finer(masks)
        more = F.create_map(*[x for m, own in below.items() for x in (F.lit(_signed(m)), F.array(*map(F.lit, own)))])
        rows = rows.where("crowd").select(F.explode(F.element_at(more, F.col("mask"))).alias("mask"), "fp")
        rows = materialise(rows.withColumn("bits", F.col("mask").bitwiseAND(F.col("fp"))).distinct(), "simhash-finer")
        masks = sorted({m % (1 << 64) for own in below.values() for m in own})
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b): the smallest node it is joined to.

    Large-star hangs a node's larger neighbours on its smallest, small-star its smaller ones;
    both keep what is joined and end in stars around the smallest.  No neighbourhood is ever
    gathered: each star is a minimum (combined before the shuffle) joined back, and a join's
    crowded key can be split.
    """
    both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(both, "components")
    before = None
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components")
        drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("a")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of those joined by links, for each row."""
    marked = materialise(add_fingerprints(docs, ["doc_id"], width), "simhash-prints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = materialise(components(links_between(prints.select("fp"), radius)), "simhash-stars")
    labels = prints.join(stars, prints["fp"] == stars["node"], "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    ids = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labels.select("fp", "label").join(ids, "label").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def print_candidates(texts: DataFrame, radius: int = MOST) -> DataFrame:
    """Pairs (a, b) of keys that join all whose fingerprints (key, fp) are linked: each fingerprint's keys with its least one."""
    prints = materialise(texts.groupBy("fp").agg(F.min("key").alias("b")), "near-prints")
    same = texts.join(prints, "fp").where("key <> b").select(F.col("key").alias("a"), "b")
    links = links_between(prints.select("fp"), radius).withColumnsRenamed({"a": "x", "b": "y"})
    ends = [prints.select(F.col("fp").alias(c), F.col("b").alias(k)) for c, k in (("x", "a"), ("y", "b"))]
    return same.unionByName(links.join(ends[0], "x").join(ends[1], "y").select("a", "b"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near-duplicates: the one of the smallest doc_id.

    Texts are linked where their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Their fingerprints within the radius give candidates, and MinHash those that no radius holds; the
    whole sets are compared after.  A row whose doc_id is null links like
    any other and stays.  Of different texts that share the smallest doc_id the one of the least hash stays.
    """
    names = docs.columns
    # the row as a struct: whatever its columns are called, they meet none of those made here
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_all"), "doc_id", "text")
    rest = [F.col("_all").getField(c) for c in names if c not in ("doc_id", "text")]
    rows = held.withColumn("_row", F.xxhash64("doc_id", whole_text())).withColumn("_rest", F.xxhash64(F.lit(0), *rest))
    marked = materialise(shingles.add_sketches(rows, ["doc_id", "_row", "_rest"]), "near-sketches")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_row")))
    texts = marked.groupBy("key").agg(first.alias("first"), F.min("_row").alias("_row"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    texts = materialise(texts, "near-texts")
    stars = materialise(components(shingles.candidates(texts).unionByName(print_candidates(texts))), "near-candidates")
    crowds = stars.groupBy("label").count().where(F.col("count") > shingles.BLOCK)
    pieces = F.coalesce(F.ceil(F.col("count") / shingles.BLOCK), F.lit(1)).cast("int")
    placed = stars.join(F.broadcast(crowds), "label", "left").select(F.col("node").alias("key"), "label", pieces.alias("pieces"))
    placed = placed.join(texts.select("key", "_row"), "key")
    own = rows.select("_row", "text").join(placed, "_row").dropDuplicates(["_row"])
    groups = materialise(components(shingles.alike(own)), "near-groups")
    labels = texts.select("key", "first").join(groups, texts["key"] == groups["node"], "left")
    firsts = labels.groupBy(F.coalesce("label", "key")).agg(F.min("first").alias("first")).where("first IS NOT NULL").select("first._row")
    # of rows alike in id and text that one stays whose other columns have the least hash
    least = marked.groupBy("_row").agg(F.min("_rest").alias("_rest"))
    firsts = materialise(firsts.join(least, "_row"), "near-firsts")
    for used in (marked, texts, stars, groups):
        drop(used)
    kept = rows.where("doc_id IS NOT NULL").join(firsts, ["_row", "_rest"], "left_semi").dropDuplicates(["_row", "_rest"]).select("_all")
    out = kept.unionByName(held.where("doc_id IS NULL").select("_all"))
    return out.select(*[F.col("_all").getField(c).alias(c) for c in names])
