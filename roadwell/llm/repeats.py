"""Operator 5: removing repeated strings with suffix sorting by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere else.

The initial buckets are those of Q-grams.  Of the Q-grams of a string the one with the least hash is
the string's anchor, so equal strings have equal anchors at equal places, and a string need only be
looked for in the bucket of its anchor.  Strings in a row that share an anchor are one segment; equal
segments count as one, with the number of their occurrences, and a segment that is met again whole
is repeated in all its strings.  What is left are the segments around the ends of repeated passages.
A bucket's segments are gathered in one task and the suffixes of their bytes sorted by bucket-pointer
refinement: each bucket is sorted by the bucket pointers at the offset for which its members agree
already, pointers are renewed in place, and buckets that come later sort by the renewed ones.

A bucket with more than ``CROWD`` different segments is refined before that, by the bytes at later
offsets: its strings are dealt out by how much of them lies before the anchor, in two halves, and
those of a half share the bytes that all of its strings cover, which are their new bucket.  A half's
strings are dealt out again in the same way while their bucket is too large; strings with one place
for the anchor share all their bytes, so this ends after eight times at the most.

Defined results: a null text is empty; texts shorter than LENGTH bytes stay whole; a text that
repeats in another row goes whole if it is that long; rows with the same doc_id and text get the
same result, each counting as an occurrence; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwell.llm.shared import drop, materialise, ship, whole_text

LENGTH = 200
Q = 32
#: Q-grams in a string of LENGTH bytes.
WIDTH = LENGTH - Q + 1
#: Different segments of one bucket that a single task sorts; larger buckets are refined first.
CROWD = 2_000
#: Bytes of the first buckets inside a task, and blocks of buckets that a round of refinement takes in turn.
GRAM, BLOCKS = 7, 4
#: Rows that may be broadcast.
SMALL = 1_000_000
#: Bytes of text that a task looks at together; longer texts go through in overlapping parts.
PART = 1 << 20

MASK = (1 << 64) - 1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each Q-gram (Q a power of two), by joining the hashes of its halves."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    width = 1
    with np.errstate(over="ignore"):
        while width < Q:
            h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * _MIX[1] + h[width:]
            width *= 2
        h ^= h >> np.uint64(32)
        h *= _MIX[0]
        h ^= h >> np.uint64(29)
    return h


def segments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first string's start, number of strings, anchor's start) for each segment of at most PART bytes."""
    h = gram_hashes(raw)
    n = len(h) - WIDTH + 1
    # the hash's upper bits, then the place: the least of a window tells where it is, the first of equals
    low = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= WIDTH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = WIDTH - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    place = (low[:n] & np.uint64((1 << 21) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    counts = np.diff(np.append(starts, n))
    anchors = place[starts]
    return h[anchors], starts, counts, anchors


def parts_of(raw: bytes):
    """(first byte, bytes) of the overlapping parts in which a text goes through."""
    for lo in range(0, len(raw) - LENGTH + 1, PART - LENGTH + 1):
        yield lo, raw[lo : lo + PART]


def met_anchors(docs: DataFrame) -> DataFrame:
    """(anchor, n): the anchors that stand at n >= 2 places of the corpus.

    Anchors travel as packed numbers, those of a batch counted first.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * n

    def find(batches):
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for raw in batch.column(0).to_pylist():
                for _, part in parts_of(raw):
                    h, _, _, anchors = segments(np.frombuffer(part, np.uint8))
                    found.append(h)
            anchors, times = np.unique(np.concatenate(found), return_counts=True)
            own = (anchors % np.uint64(parts)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            anchors, times, own = anchors[order], times[order].astype("<u4"), own[order]
            edges = np.searchsorted(own, np.arange(parts + 1)).tolist()
            held = [k for k in range(parts) if edges[k] < edges[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(held, pa.int32()),
                    pa.array([anchors[edges[k] : edges[k + 1]].tobytes() for k in held], pa.binary()),
                    pa.array([times[edges[k] : edges[k + 1]].tobytes() for k in held], pa.binary()),
                ],
                ["part", "anchors", "times"],
            )

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for anchors, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append((np.frombuffer(anchors, np.uint64), np.frombuffer(times, "<u4").astype(np.int64)))
        if held:
            anchors, at = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            times = np.bincount(at, np.concatenate([t for _, t in held])).astype(np.int64)
            again = times >= 2
            yield pa.RecordBatch.from_arrays([pa.array(anchors[again].view(np.int64)), pa.array(times[again])], ["anchor", "n"])

    raw = docs.select(F.encode(whole_text(), "utf-8").alias("raw"))
    packed = raw.mapInArrow(find, "part int, anchors binary, times binary")
    return packed.repartition(n, "part").mapInArrow(count, "anchor long, n long")


SEGMENT = "anchor long, segment long, doc_id long, key long, start long, strings int, at int"


def text_segments(docs: DataFrame) -> DataFrame:
    """A row for each segment of each text: anchor, segment hash, text key, start, strings, the anchor's place in it."""
    ship(docs.sparkSession)

    def find(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, key, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for lo, part in parts_of(raw):
                    anchor, starts, counts, places = segments(np.frombuffer(part, np.uint8))
                    ends = (starts + counts + (LENGTH - 1)).tolist()
                    # where the anchor lies in it is part of what a segment is
                    seeds = places - starts
                    view = memoryview(part)
                    out[1].extend(map(xxh3_64_intdigest, [view[a:b] for a, b in zip(starts.tolist(), ends)], seeds.tolist()))
                    out[0].append(anchor)
                    out[2].extend([doc] * len(starts))
                    out[3].extend([key] * len(starts))
                    out[4].append(starts + lo)
                    out[5].append(counts)
                    out[6].append(seeds)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(out[0]).view(np.int64)),
                        pa.array(np.array(out[1], np.uint64).view(np.int64)),
                        pa.array(out[2], pa.int64()),
                        pa.array(out[3], pa.int64()),
                        pa.array(np.concatenate(out[4]).astype(np.int64)),
                        pa.array(np.concatenate(out[5]).astype(np.int32)),
                        pa.array(np.concatenate(out[6]).astype(np.int32)),
                    ],
                    [x.split()[0] for x in SEGMENT.split(", ")],
                )

    held = docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("key"), F.encode(whole_text(), "utf-8").alias("raw"))
    return held.mapInArrow(find, SEGMENT)


def bucket_pointers(text: np.ndarray, limit: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(pointer, known): bucket pointers of all suffixes, and for how many bytes the members of each one's bucket agree.

    text: bytes; limit: for each position the end of its own text, beyond which nothing follows.
    Bucket-pointer refinement: a pointer is the place of its bucket's last member in the order of the
    suffixes.  A bucket that agrees for k bytes is sorted by the pointers k bytes on, whatever depth
    those have by now, and its members' pointers are renewed in place; the blocks of buckets that
    come after it in the same round sort by the renewed ones.  Buckets that agree for depth bytes, or
    whose members have all ended, rest.
    """
    n = len(text)
    digits = np.concatenate([text.astype(np.int64) + 1, np.zeros(GRAM, np.int64)])
    reach = limit - np.arange(n)
    grams = np.zeros(n, np.int64)
    for k in range(GRAM):
        # a text's end sorts before every byte
        grams = grams * 257 + np.where(reach > k, digits[k : k + n], 0)
    # gathers from narrow columns take half the time
    whole = np.int32 if n + depth < 1 << 31 else np.int64
    order = np.argsort(grams)
    first = grams[order]
    order, reach, limit = order.astype(whole), reach.astype(whole), limit.astype(whole)
    pointer = np.empty(n, whole)
    known = np.full(n, GRAM, whole)
    pointer[order] = _ends(first[1:] == first[:-1])
    del grams, digits, first
    places = np.arange(n)
    while True:
        # order holds a bucket's members side by side, at places that refining never leaves; what rests once rests for good
        todo = order[places]
        bucket, agreed = pointer[todo], known[todo]
        goes = (np.bincount(pointer, minlength=n)[bucket] > 1) & (agreed < depth) & (agreed <= reach[todo])
        places, todo, bucket, agreed = places[goes], todo[goes], bucket[goes], agreed[goes]
        if not len(todo):
            return pointer, known
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        firsts = np.unique(cuts[np.searchsorted(cuts, np.arange(0, len(todo), -(-len(todo) // BLOCKS)), "right") - 1])
        for lo, hi in zip(firsts, [*firsts[1:], len(todo)]):
            some, old, held = todo[lo:hi], bucket[lo:hi], agreed[lo:hi]
            on = some + held
            at = np.minimum(on, n - 1)
            later = np.where(on < limit[some], pointer[at], whole(-1))
            held += np.where(later >= 0, known[at], whole(depth))
            turn = np.argsort(old * np.int64(n + 1) + later + 1)
            some, later, held = some[turn], later[turn], held[turn]
            begin = np.concatenate([[True], old[1:] != old[:-1]])
            same = ~begin[1:] & (later[1:] == later[:-1])
            # a bucket's last member keeps its place; the members before it stand one place down each
            place = old - (_ends(~begin[1:]) - np.arange(len(some)))
            order[place] = some
            pointer[some] = place[_ends(same)]
            known[some] = held


def _ends(same: np.ndarray) -> np.ndarray:
    """For sorted members the place of the last one of each one's bucket."""
    last = np.flatnonzero(np.concatenate([~same, [True]]))
    return np.repeat(last, np.diff(last, prepend=-1))


def refine(text: np.ndarray, starts: np.ndarray, limit: np.ndarray, length: int) -> np.ndarray:
    """A number for each string of the given length: the same for equal ones."""
    if not len(starts):
        return np.empty(0, np.int64)
    pointer, known = bucket_pointers(text, limit, length)
    by = np.argsort(pointer[starts])
    some = starts[by]
    # in one bucket of that depth strings are equal; neighbours in two may be, where it went deeper
    equal = (pointer[some][1:] == pointer[some][:-1]) & (known[some][1:] >= length)
    left = np.flatnonzero(~equal)
    # the eight bytes from each place on, as one number
    words = np.ndarray(len(text) - 7, np.int64, text, strides=(1,))
    for k in range(0, length, 8):
        at = min(k, length - 8)
        same = words[some[left] + at] == words[some[left + 1] + at]
        left = left[same]
    equal[left] = True
    out = np.empty(len(starts), np.int64)
    out[by] = np.concatenate([[0], np.cumsum(~equal)])
    return out


def sort_group(parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of some segments, in order, their bucket and each bucket's number of occurrences.

    parts: bytes and number of occurrences of different segments.
    """
    text = np.frombuffer(b"".join(p for p, _ in parts), np.uint8)
    ends = np.cumsum([len(p) for p, _ in parts])
    lengths = np.array([len(p) for p, _ in parts])
    limit = np.repeat(ends, lengths)
    starts = np.concatenate([np.arange(e - n, e - LENGTH + 1) for e, n in zip(ends, lengths)])
    times = np.repeat([m for _, m in parts], lengths - LENGTH + 1)
    bucket = refine(text, starts, limit, LENGTH)
    return bucket, np.bincount(bucket, weights=times).astype(np.int64)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of each run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


FOUND = "bucket long, piece long, spans array<struct<first: int, past: int>>"
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
#: Pieces of a bucket: bytes, where the anchor lies in them, and how often they occur.
PIECE = "bucket long, piece long, at int, times long, raw binary"


def compare_pieces(pieces: DataFrame) -> DataFrame:
    """Repeated strings of the pieces: (bucket, piece, spans of string numbers); a bucket's are sorted together."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(batches):
        held: list[tuple] = []

        def flush(rows):
            out = []
            group: list[tuple] = []
            size = 0

            def settle():
                nonlocal group, size
                if group:
                    # texts of different buckets do not meet: equal strings have equal anchors
                    bucket, times = sort_group([(r[3], r[2]) for r in group])
                    again, at = times[bucket] >= 2, 0
                    for r in group:
                        k = len(r[3]) - LENGTH + 1
                        found = runs(again[at : at + k])
                        at += k
                        if found:
                            out.append((r[0], r[1], [{"first": a, "past": b} for a, b in found]))
                group, size = [], 0

            for k, r in enumerate(rows):
                if size > 1 << 21 and rows[k - 1][0] != r[0]:
                    settle()
                group.append(r)
                size += len(r[3])
            settle()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], SPANS)],
                ["bucket", "piece", "spans"],
            )

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(4)))
            cut = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
            if cut > 2000:
                yield flush(held[:cut])
                held = held[cut:]
        if held:
            yield flush(held)

    columns = pieces.select("bucket", "piece", "times", "raw")
    return columns.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, FOUND)


def split_pieces(pieces: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """The pieces dealt out by how many bytes of a string lie before its anchor: from (bucket, piece), its string first.

    Strings of one range all cover the bytes from the least of it before the anchor to the most of it
    behind; with the range those are the new bucket.
    """

    def split(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows: list[tuple] = []
            for bucket, piece, at, times, raw in zip(*(batch.column(k).to_pylist() for k in range(5))):
                last = len(raw) - LENGTH
                for low, high in ranges:
                    first, past = max(0, at - high), min(last, at - low) + 1
                    if first < past:
                        shared = raw[at - low : at + LENGTH - high] if at >= low else None
                        own = raw[first : past + LENGTH - 1]
                        rows.append(
                            (
                                xxh3_64_intdigest(shared, (bucket ^ (low << 32 | high)) & MASK),
                                xxh3_64_intdigest(own, at - first),
                                at - first, times, own, bucket, piece, first,
                            )
                        )
            columns = [list(c) for c in zip(*rows)] or [[] for _ in range(8)]
            for k in (0, 1):
                columns[k] = np.array(columns[k], np.uint64).view(np.int64)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["bucket", "piece", "at", "times", "raw", "of_bucket", "of_piece", "first"]
    columns = pieces.select("bucket", "piece", "at", "times", "raw")
    return columns.mapInArrow(split, PIECE + ", of_bucket long, of_piece long, first int")


def crowded(pieces: DataFrame, name: str) -> DataFrame:
    """pieces with the flag crowd: whether its bucket has more than CROWD of them."""
    crowds = materialise(pieces.groupBy("bucket").count().where(F.col("count") > CROWD).select("bucket"), name)
    # a crowd has many rows, so there are few; beyond SMALL the join is dealt out like any other
    crowds = F.broadcast(crowds) if crowds.count() <= SMALL else crowds
    return pieces.join(crowds.withColumn("crowd", F.lit(True)), "bucket", "left").withColumn("crowd", F.col("crowd").isNotNull())


def repeated_strings(pieces: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """(bucket, piece, spans of string numbers) for the pieces with repeated strings.

    low and high bound how many bytes of a string lie before its anchor.
    """
    high = LENGTH - Q if high is None else high
    ranges = [(low, high)]
    found: list[DataFrame] = []
    links: list[DataFrame] = []
    while True:
        marked = crowded(pieces, "repeats-crowds")
        own = materialise(compare_pieces(marked.where("NOT crowd").drop("crowd")), "repeats-found")
        found.append(own)
        if marked.where("crowd").isEmpty():
            break
        ranges = [r for a, b in ranges for r in ((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if r[0] <= r[1]]
        below = materialise(split_pieces(marked.where("crowd").drop("crowd"), ranges), "repeats-split")
        links.append(below.select("bucket", "piece", "of_bucket", "of_piece", "first"))
        pieces = below.groupBy("bucket", "piece").agg(
            F.any_value("at").alias("at"), F.sum("times").alias("times"), F.any_value("raw").alias("raw")
        )
        pieces = materialise(pieces, "repeats-pieces")
    # from the finest pieces up, what is found goes to the pieces they were cut from
    below = found.pop()
    while links:
        up = links.pop().join(below, ["bucket", "piece"])
        up = up.select(
            F.col("of_bucket").alias("bucket"), F.col("of_piece").alias("piece"), F.col("first").alias("by"), F.explode("spans").alias("s")
        )
        moved = F.struct((F.col("s.first") + F.col("by")).alias("first"), (F.col("s.past") + F.col("by")).alias("past"))
        up = up.groupBy("bucket", "piece").agg(F.collect_list(moved).alias("spans"))
        below = found.pop().unionByName(up)
    return below


def take_pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (bucket, piece, at, times, doc_id, key, start, strings) with the bytes of each segment."""
    ship(docs.sparkSession)
    spots = wanted.groupBy(F.struct("doc_id", "key").alias("_key")).agg(
        F.collect_list(F.struct("bucket", "piece", "at", "times", "start", "strings")).alias("spots")
    )
    texts = keyed(docs).select("_key", F.col("_text").alias("text")).join(spots, "_key").select("spots", F.encode("text", "utf-8").alias("raw"))

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                rows = [
                    (s["bucket"], s["piece"], s["at"], s["times"], raw[s["start"] : s["start"] + s["strings"] + LENGTH - 1])
                    for spots, raw in zip(some.column(0).to_pylist(), some.column(1).to_pylist())
                    for s in spots
                ]
                columns = list(zip(*rows)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "piece", "at", "times", "raw"])

    # rows that share id and text give the same pieces
    return texts.mapInArrow(cut, PIECE).dropDuplicates(["bucket", "piece"])


def keyed(docs: DataFrame) -> DataFrame:
    step = docs.select(F.col("doc_id").cast("long"), whole_text().alias("_text"))
    return step.select("doc_id", F.struct("doc_id", F.xxhash64("_text").alias("key")).alias("_key"), "_text")


def with_met_anchors(marks: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of marks whose anchor is in met.

    Anchors with more than their share of all places are few, by that share, and broadcast; their
    rows join on a key of their own each, so that no task gets all rows of one anchor.
    """
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (met.agg(F.sum("n")).first()[0] or 0) // (4 * n) + 1
    hot = met.where(F.col("n") > share).select("anchor", F.lit(True).alias("hot"))
    rows = marks.join(F.broadcast(hot), "anchor", "left")
    rows = rows.withColumn("_at", F.when(F.col("hot"), F.xxhash64("segment", "doc_id", "key", "start")).otherwise(F.col("anchor")))
    cold = met.where(F.col("n") <= share).select(F.col("anchor").alias("_at"), F.lit(True).alias("cold"))
    return rows.join(cold, "_at", "left").where("hot OR cold").drop("_at", "hot", "cold")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """_key (doc_id and text hash) and spans, the merged byte spans to remove, for the texts that have any."""
    met = materialise(met_anchors(docs), "repeats-met")
    marks = materialise(with_met_anchors(text_segments(docs), met), "repeats-segments")
    sorts = marks.groupBy(F.col("anchor").alias("bucket"), F.col("segment").alias("piece")).agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "key", "start", "strings", "at")).alias("spot")
    )
    sorts = materialise(sorts, "repeats-sorts")
    # an anchor with a single segment has nothing to sort; crowds are told apart first, as no task may get all their rows
    marked = crowded(sorts, "repeats-crowds")
    kinds = sorts.groupBy("bucket").count().where(F.col("count").between(2, CROWD)).select(F.col("bucket").alias("_at"), F.lit(True).alias("few"))
    marked = marked.withColumn("_at", F.when(F.col("crowd"), F.xxhash64("bucket", "piece")).otherwise(F.col("bucket")))
    several = marked.join(kinds, "_at", "left").where("crowd OR few").select("bucket", "piece", "times", "spot.*")
    pieces = materialise(take_pieces(docs, several), "repeats-pieces")
    partly = materialise(repeated_strings(pieces), "repeats-strings")
    drop(pieces)
    # a segment met again whole is repeated in every string, alone at its anchor or not
    whole = sorts.where("times >= 2").select("bucket", "piece", F.col("spot.strings").alias("all"))
    found = whole.join(partly, ["bucket", "piece"], "full")
    spans = F.when(F.col("all").isNotNull(), F.array(F.struct(F.lit(0).alias("first"), F.col("all").alias("past")))).otherwise(F.col("spans"))
    found = found.select(F.col("bucket").alias("anchor"), F.col("piece").alias("segment"), spans.alias("spans"))
    placed = marks.join(found, ["anchor", "segment"]).select(F.struct("doc_id", "key").alias("_key"), "start", F.explode("spans").alias("s"))
    covered = placed.select("_key", F.struct((F.col("start") + F.col("s.first")).alias("a"), (F.col("start") + F.col("s.past") + LENGTH - 1).alias("b")).alias("span"))
    spans = materialise(covered.groupBy("_key").agg(F.collect_set("span").alias("spans")), "repeats-spans")
    for held in (met, marks, sorts, partly):
        drop(held)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that are left), n_bytes, n_removed, n_spans for each row of docs."""
    ship(docs.sparkSession)
    spans = repeated_spans(docs)
    joined = keyed(docs).join(spans, "_key", "left").select("doc_id", F.encode("_text", "utf-8").alias("raw"), "spans")

    def drop(batches):
        for batch in batches:
            rows = []
            for doc, raw, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                kept, at, removed, n = [], 0, 0, 0
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if a > at or not n:
                        kept.append(raw[at:a])
                        n += 1
                        removed += b - a
                    elif b > at:
                        removed += b - at
                    at = max(at, b)
                kept.append(raw[at:])
                rows.append((doc, b"".join(kept), len(raw), removed, n))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(drop, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
