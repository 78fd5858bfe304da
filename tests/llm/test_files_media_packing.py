import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadwell.llm import media, packing, token_store
from roadwell.llm.queries import vocabulary
from roadwell.llm.shared import new_folder
from roadwell.llm.token_cache import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, bin string"
ODD = ["don't  stop\n\n\nnow  ", "É'S ÀÇ²³½ 12½", "x\xa0y", "a​b  ", "", "   ", "''s tart''", "İstanbul ǅ", "ab<|endoftext|>cd",
       "\t\t a\r\n b", "a  b", "a \n b", "a\nb c.\nD", " x", "ß soft\xadhyphen", None]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None, 5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    encoder = Encoder(vocabulary(name), kept=50)
    rnd = random.Random(3)
    texts = [t for t in ODD if t is not None]
    texts += ["".join(rnd.choice("ab É1,.'\n s²") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in encoder.ids(texts)] == want


def test_token_files_round_trip(spark):
    ids = [7, 3, None, 3, 1, *range(100, 100 + len(ODD) - 5)]
    frame = docs(spark, ODD, ids)
    library = Encoder(vocabulary("byte_bpe_50k.json")).library
    folder = new_folder(spark, "test-tokens")
    found = token_store.read_token_files(token_store.write_token_files(frame, folder, vocabulary("byte_bpe_50k.json"), 2)).collect()
    assert len(found) == len(ODD)
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((d, crc(t)) for d, t in zip(ids, ODD))
    rows = sorted(found, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda d: -1 if d is None else d)
    empty = token_store.write_token_files(frame.limit(0), new_folder(spark, "none"), vocabulary("byte_bpe_50k.json"), 2)
    assert token_store.read_token_files(empty).count() == 0


def test_media_round_trip(spark):
    long = "é" * 200_000
    texts = ["", None, "a", "a", "x" * 64, "y" * 65, long]
    stored = media.to_media(docs(spark, texts))
    rows = media.probe(stored, ["doc_id", "n_bytes"]).orderBy("doc_id").collect()
    import hashlib

    for row, text in zip(rows, texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[2][2:] == rows[3][2:] and rows[0][2:] == rows[1][2:]
    assert media.probe(media.to_media(docs(spark, [])), ["doc_id"]).count() == 0


def test_boxes_are_walked():
    payload = bytes(range(256)) * 700
    raw = media.sound_file(payload)
    (track,) = media.decode(raw)
    assert track.codec == "raw" and track.timescale == 8000 and track.duration == len(payload) == len(track.sizes)
    assert b"".join(raw[a:b] for a, b in track.keyframes) == payload
    with pytest.raises(ValueError):
        media.decode(raw[:-10])


def test_key_frames_of_a_table_with_sync_samples():
    """A hand-made track: samples of 3, 5 and 7 bytes in two chunks, the first and the third key frames."""
    import struct

    box, full = media.box, media.full_box
    stbl = lambda a, b: box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", struct.pack(">III", 1, 3, 10)),
        full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 3, 5, 7)),
        full(b"stco", struct.pack(">III", 2, a, b)), full(b"stss", struct.pack(">III", 2, 1, 3)),
    )
    mdia = lambda a, b: box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 30, 0, 0)), box(b"minf", stbl(a, b)))))
    begin = len(mdia(0, 0)) + 8
    raw = mdia(begin, begin + 20) + box(b"mdat", bytes(40))
    (track,) = media.decode(raw)
    assert track.codec == "avc1" and track.duration / track.timescale == 0.3
    assert track.keyframes == [(begin, begin + 3), (begin + 20, begin + 27)]
    assert track.offsets.tolist() == [begin, begin + 3, begin + 20]


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fills = packing.best_fit([5, 4, 3, 2, 6], 10)
    assert sorted(fills) == [10, 10] and offsets[4] == 0


def check_packing(rows, texts, size):
    library = Encoder(vocabulary("word_bpe_49k.json")).library
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    assert {r.doc_id for r in rows} == set(texts)
    by = defaultdict(list)
    for r in rows:
        assert r.start == size * r.piece
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and (r.length == size or r.start + r.length == len(ids[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(map(len, ids.values())) // size)


def test_packing(spark):
    rnd = random.Random(1)
    texts = {i: " ".join(rnd.choice(["the", "of", "xyzzy", "é"]) for _ in range(rnd.choice([0, 3, 30, 300, 700]))) for i in range(120)}
    texts[7] = None
    texts[8] = "word " * 5000
    frame = docs(spark, list(texts.values())).repartition(7)
    rows = packing.pack_documents(frame, vocabulary("word_bpe_49k.json")).collect()
    used, least = check_packing(rows, texts, 2048)
    assert used <= least + 2
    assert packing.pack_documents(frame.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_by_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    texts = {i: "a b " * (40 + i) for i in range(200)}
    rows = packing.pack_documents(docs(spark, list(texts.values())).repartition(9), vocabulary("word_bpe_49k.json")).collect()
    used, least = check_packing(rows, texts, 2048)
    assert used <= 1.2 * least + 2


def test_repeated_and_null_ids_are_packed_each(spark):
    frame = docs(spark, ["a b", "a b", "c"], [5, 5, None])
    rows = packing.pack_documents(frame, vocabulary("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 2)]
    assert packing.pack_documents(frame, vocabulary("word_bpe_49k.json")).select(F.count_distinct("sequence_id")).first()[0] == 1


def test_media_of_any_value(spark):
    good = media.sound_file(b"x" * 64)
    frame = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"no box at all"), (5, good[:-90])], "doc_id long, media binary")
    rows = media.probe(frame, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.payload_bytes for r in rows] == [64, None, None, None, None]
    assert [r.feature == "damaged" for r in rows] == [False, False, True, True, True] and rows[1].media_bytes is None
    stored = media.to_media(spark.createDataFrame([(1, "a", "own", 7)], "doc_id long, text string, media string, n_bytes int"))
    assert stored.columns == ["doc_id", "text", "n_bytes", "media"] and stored.first().n_bytes == 1
