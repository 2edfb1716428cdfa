import hashlib
import random
import struct
import zlib

import pytest

from kindred.llm import gif_media as g
from kindred.llm import queries


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trip(bits):
    random.seed(bits)
    for n in (0, 1, 2, 3, 255, 4000, 30000):
        for colours in (1, 2, 1 << bits):
            data = bytes(random.randrange(colours) for _ in range(n))
            assert g.lzw_decode(g.lzw_encode(data, bits), bits, n) == data


def block(data, bits):
    stream = g.lzw_encode(data, bits)
    return bytes((bits,)) + b"".join(bytes((len(stream[i : i + 255]),)) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\0"


def control(disposal, clear=None, delay=5):
    return b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"


def image(left, top, w, h, data, flags=0, palette=b""):
    return b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + block(bytes(data), 2)


HEAD = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + bytes((10, 0, 0, 20, 0, 0, 30, 0, 0, 40, 0, 0))


def test_disposal_and_transparency():
    data = HEAD + b"\x21\xfe\x03abc\0" + control(1) + image(0, 0, 2, 2, [0, 1, 2, 3]) + control(3, clear=0) + image(0, 0, 2, 1, [0, 3]) + control(2) + image(1, 1, 1, 1, [0]) + control(0) + image(0, 0, 1, 1, [1]) + b"\x3b"
    red = [f.canvas[:, :, 0].tolist() for f in g.decode(data)]
    assert red == [[[10, 20], [30, 40]], [[10, 40], [30, 40]], [[10, 20], [30, 10]], [[20, 20], [30, 0]]]
    assert [f.delay_ms for f in g.decode(data)] == [50] * 4
    last = list(g.decode(data))[-1]
    assert last.canvas[1, 1].tolist() == [0, 0, 0, 0]


def test_local_palette_and_interlace():
    own = bytes((1, 2, 3)) * 4
    data = b"GIF87a" + struct.pack("<HHBBB", 1, 9, 0x81, 0, 0) + HEAD[13:] + image(0, 0, 1, 9, [0, 0, 1, 1, 1, 2, 2, 2, 2], 0x40) + image(0, 0, 1, 1, [0], 0x81, own) + b"\x3b"
    first, second = g.decode(data)
    assert first.canvas[:, 0, 0].tolist() == [10, 30, 20, 30, 20, 30, 20, 30, 10] and second.canvas[0, 0].tolist() == [1, 2, 3, 255]


def test_frames_table(spark):
    good = HEAD + control(1) + image(0, 0, 2, 2, [0, 1, 2, 3]) + control(1) + image(0, 0, 1, 1, [3]) + b"\x3b"
    rows = g.frames(spark.createDataFrame([(1, good), (2, None), (3, b"no"), (4, good[:40])], "id long, frame binary"), "id", "frame").orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.start_ms, r.error is None) for r in rows if r.id == 1] == [(1, 0, 0, True), (1, 1, 50, True)]
    assert not [r for r in rows if r.id == 2] and all(r.error for r in rows if r.id in (3, 4) and r.frame is None)
    assert sum(rows[0].histogram) == 4 and len(rows[0].histogram) == 64 and len(rows[0].rgba) == 16


def test_hostile_headers_are_errors(spark):
    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x81, 0, 0) + HEAD[13:] + image(0, 0, 2, 2, [0, 1, 2, 3]) + b"\x3b"
    inner = HEAD + control(1) + image(0, 0, 2, 2, [0, 1, 2, 3]) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + block(bytes([0]), 2) + b"\x3b"
    code = HEAD + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + bytes((200, 0)) + b"\x3b"
    rows = g.frames(spark.createDataFrame([(1, bomb), (2, inner), (3, code)], "id long, m binary"), "id", "m").collect()
    assert sorted((r.id, r.frame is None, r.error is not None) for r in rows) == [(1, True, True), (2, False, False), (2, True, True), (3, True, True)]


def test_a_medium_of_another_writer():
    """A 3 x 2 image written by hand, code by code: clear, 1, 1, 6 (the run just made), 2, stop."""
    codes, bits, n = [(4, 3), (1, 3), (1, 3), (6, 3), (2, 4), (5, 4)], 0, 0
    for value, width in codes:
        bits |= value << n
        n += width
    stream = bits.to_bytes((n + 7) // 8, "little")
    data = b"GIF87a" + struct.pack("<HHBBB", 3, 2, 0x81, 0, 0) + HEAD[13:] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + bytes((2, len(stream))) + stream + b"\0\x3b"
    (frame,) = g.decode(data)
    assert frame.canvas[:, :, 0].tolist() == [[20, 20, 20], [20, 30, 10]]


def test_texts_come_back(docs):
    long = "grün " * 30_000
    rows = g.text_media(docs((1, None), (2, ""), (3, "x" * 576), (3, "x" * 576), (4, long))).collect()
    for r in rows:
        raw = {3: "x" * 576, 4: long}.get(r.doc_id, "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 3}) == 1
    assert g.text_media(docs((1, "")).limit(0)).collect() == []


def test_query(spark, small):
    rows = queries.op7_gif_media(spark, small).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows:
        assert r.payload_sha256 == hashlib.sha256(g.padded(texts[r.doc_id])).hexdigest() and r.media_sha256 == hashlib.sha256(g.encode_payload(g.padded(texts[r.doc_id]))).hexdigest()
