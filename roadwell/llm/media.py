"""Operator 2: media columns.

``to_media`` stores each text's bytes as an 8-bit sound track in an ISO base media file;
``probe`` walks the nested boxes of any such file, decodes its sample tables and reports codec,
duration and the byte ranges of key frames without decoding a payload.

Defined results: a null text is empty; an empty text has one block of 64 zero bytes; equal texts
give equal files, as no box holds a time or a random value; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwell.llm.shared import ship, whole_text

BLOCK = 64
RATE = 8000
CHUNK = 1 << 16
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def sound_file(payload: bytes) -> bytes:
    """An ISO base media file whose only track holds the payload as 8-bit samples, one channel."""
    n = len(payload)
    chunks = max(1, -(-n // CHUNK))
    matrix = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    wide = n >= 1 << 31
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, min(n, CHUNK), 1)]
    if chunks > 1 and n % CHUNK:
        runs.append((chunks, n % CHUNK, 1))

    def movie(first: int) -> bytes:
        places = first + CHUNK * np.arange(chunks, dtype=np.int64)
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, 1)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", 1, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">i8" if wide else ">u4").tobytes()),
        )
        return box(
            b"moov",
            full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, min(n, 0xFFFFFFFF), 1 << 16, 1 << 8), bytes(10), matrix, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, min(n, 0xFFFFFFFF)), bytes(8), struct.pack(">HHHH", 0, 0, 1 << 8, 0), matrix, bytes(8)),
                box(
                    b"mdia",
                    full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, min(n, 0xFFFFFFFF), 0x55C4, 0)),
                    full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
                    box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), table),
                ),
            ),
        )

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    begin = len(head) + len(movie(0)) + (8 if n + 8 < 1 << 32 else 16)
    return b"".join([head, movie(begin), box(b"mdat", payload)])


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    #: One entry for each sample.
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: Byte ranges of key frames that follow each other, as one.
    keyframes: list[tuple[int, int]] = field(default_factory=list)
    #: Byte ranges of all samples.
    extents: list[tuple[int, int]] = field(default_factory=list)


def walk(data: memoryview, begin: int = 0, end: int | None = None, path: tuple = ()):
    """(path of kinds, begin of the body, its end) for each box, outer ones first."""
    end = len(data) if end is None else end
    while begin + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if begin + 16 > end:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else begin + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} is longer than what holds it")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))
        begin = stop


def joined(begins: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, those that touch made one."""
    if not len(begins):
        return []
    ends = begins + sizes
    new = np.concatenate([[True], begins[1:] != ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begins) - 1]])
    return list(zip(begins[new].tolist(), ends[last].tolist()))


def _numbers(data: memoryview, at: int, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def decode(data: bytes) -> list[Track]:
    """The tracks of an ISO base media file; raises ValueError where boxes contradict each other."""
    view = memoryview(data)
    tracks: list[Track] = []
    boxes: list[dict] = []
    for path, at, _ in walk(view):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
            boxes.append({})
        elif boxes and b"trak" in path:
            boxes[-1][kind] = at
    for track, at in zip(tracks, boxes):
        place = at[b"mdhd"]
        if data[place] == 1:
            track.timescale, track.duration = struct.unpack_from(">IQ", view, place + 20)
        else:
            track.timescale, track.duration = struct.unpack_from(">II", view, place + 12)
        track.codec = bytes(view[at[b"stsd"] + 12 : at[b"stsd"] + 16]).decode("latin-1").strip()
        size, n = struct.unpack_from(">II", view, at[b"stsz"] + 4)
        track.sizes = np.full(n, size, np.int64) if size else _numbers(view, at[b"stsz"] + 12, n, ">u4")
        if b"co64" in at:
            place, kind = at[b"co64"], ">i8"
        else:
            place, kind = at[b"stco"], ">u4"
        chunks = _numbers(view, place + 8, struct.unpack_from(">I", view, place + 4)[0], kind)
        runs = struct.unpack_from(">I", view, at[b"stsc"] + 4)[0]
        table = _numbers(view, at[b"stsc"] + 8, 3 * runs, ">u4").reshape(-1, 3)
        per = np.repeat(table[:, 1], np.diff(np.append(table[:, 0], len(chunks) + 1)))
        if per.sum() != n:
            raise ValueError("the sample tables disagree")
        inside = np.cumsum(track.sizes) - track.sizes
        first = np.cumsum(per) - per
        held = per > 0
        shift = np.zeros(len(chunks), np.int64)
        shift[held] = chunks[held] - inside[first[held]]
        track.offsets = inside + np.repeat(shift, per)
        track.extents = joined(track.offsets, track.sizes)
        if b"stss" in at:
            count = struct.unpack_from(">I", view, at[b"stss"] + 4)[0]
            keys = _numbers(view, at[b"stss"] + 8, count, ">u4") - 1
            track.keyframes = joined(track.offsets[keys], track.sizes[keys])
        else:
            track.keyframes = track.extents
        if track.extents and max(e for _, e in track.extents) > len(data):
            raise ValueError("a sample lies behind the end of the file")
    return tracks


def to_media(docs: DataFrame) -> DataFrame:
    """docs with the columns n_bytes (of the text) and media (the file that holds it).

    Columns of docs with those names give way to the new ones, those called _raw and the like stay.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_bytes", "media")]
    raw = F.encode(whole_text(), "utf-8")
    held = docs.select(*[F.col(f"`{c}`") for c in names], F.octet_length(whole_text()).cast("long").alias("n_bytes"), raw.alias("media"))

    def store(batches):
        for batch in batches:
            k = len(names) + 1
            for lo in range(0, max(1, batch.num_rows), 512):
                some = batch.slice(lo, 512)
                files = []
                for raw in some.column(k).to_pylist():
                    files.append(sound_file(raw + bytes(-len(raw) % BLOCK or BLOCK * (not raw))))
                yield some.set_column(k, some.schema.field(k), pa.array(files, some.schema.field(k).type))

    return held.mapInArrow(store, held.schema)


def probe(media: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep with what the boxes of the column media say, and checksums of the samples.

    A null value has nulls alone, and so has one that is no such file, but for its length, its
    checksum and the feature damaged.
    """
    ship(media.sparkSession)
    columns = media.select(*keep, "media")
    found = {
        "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    }

    def look(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(found)
        own = len(raw), hashlib.sha256(raw).hexdigest()
        try:
            track = decode(raw)[0]
            seconds = track.duration / track.timescale
        except (ValueError, IndexError, KeyError, struct.error, ZeroDivisionError):
            return (None, None, None, *own, "damaged")
        view = memoryview(raw)
        payload = b"".join(view[a:b] for a, b in track.extents)
        keys = ",".join(f"{a}-{b}" for a, b in track.keyframes)
        feature = f"codec={track.codec};seconds={seconds:.6f};samples={len(track.sizes)};keyframes={keys}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), *own, feature

    def read(batches):
        for batch in batches:
            rows = [look(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            own = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns = zip(*rows) if rows else [[] for _ in found]
            arrays = own + [pa.array(list(c), t) for c, t in zip(columns, found.values())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *found])

    types = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep] + [f"{k} {types[t]}" for k, t in found.items()])
    return columns.mapInArrow(read, schema)
