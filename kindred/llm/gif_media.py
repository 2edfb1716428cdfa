"""GIF media columns: LZW code streams decoded, palettes, interlace, transparency and disposal applied, and
timed frames stored with colour-histogram columns. A lossless writer makes the animations read back.

A null medium gives no frames; one that cannot be read, or whose canvas or an image has more than MOST_PIXELS, gives a row
with ``error`` set and ``frame`` null after the frames that could be read; frames leave a task one by one; rows are
handled one by one, so that repeated rows repeat and an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean

# Fixed values of the format and of the payload's layout.
MOST_CODES = 4096
BLOCK = 576
ROWS = 64
DELAY_CS = 4
HIST_BINS = 64
#: Pixels of a canvas or an image at most: a header of a few bytes may ask for gigabytes.
MOST_PIXELS = 1 << 24


def _widths(first: int, count: int, bits: int) -> np.ndarray:
    """Bits of the codes ``first`` .. since the table was cleared: the reader's table has grown by one for each but the first."""
    held = (1 << bits) + 2 + np.maximum(np.arange(first, first + count) - 1, 0)
    return np.clip(np.floor(np.log2(held)).astype(np.int64) + 1, bits + 1, 12)


def lzw_encode(pixels: bytes, bits: int = 8) -> bytes:
    """A GIF code stream for the indices ``pixels``."""
    clear, stop = 1 << bits, (1 << bits) + 1
    most = MOST_CODES - stop - 1  # codes in a run between two clear codes
    codes, runs = [], []
    table: dict[int, int] = {}
    known, fresh, prefix = table.get, stop + 1, -1
    add = codes.append
    for c in pixels:
        if prefix < 0:
            prefix = c
            continue
        key = prefix << 8 | c
        longer = known(key)
        if longer is not None:
            prefix = longer
            continue
        add(prefix)
        table[key] = fresh
        fresh += 1
        prefix = c
        if fresh == MOST_CODES:
            runs.append(codes)
            codes, fresh = [], stop + 1
            add = codes.append
            table.clear()
    if prefix >= 0:
        add(prefix)
    assert all(len(r) == most for r in runs)
    values, widths = [np.array([clear])], [np.array([bits + 1])]
    for i, r in enumerate([*runs, codes]):
        values += [np.array(r, np.int64), np.array([clear if i < len(runs) else stop])]
        widths.append(_widths(0, len(r) + 1, bits))
    v, w = np.concatenate(values).astype(np.uint16), np.concatenate(widths)
    spread = (v[:, None] >> np.arange(12, dtype=np.uint16)).astype(np.uint8) & 1
    return np.packbits(spread[np.arange(12) < w[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, pixels: int) -> bytes:
    """The indices of a GIF code stream, at most ``pixels`` of them; a stream that ends early gives fewer."""
    clear, stop = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    end = len(stream) * 8
    out: list[bytes] = []
    made, at, since = 0, 0, 0
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    table, before = base[:], b""
    while made < pixels and at < end:
        widths = _widths(since, MOST_CODES, bits)
        places = at + np.cumsum(widths) - widths
        places = places[places + widths <= end]
        if not len(places):
            break
        widths = widths[: len(places)]
        byte = places >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (places & 7)) & ((1 << widths) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        count = int(marks[0]) if len(marks) else len(codes)
        size = len(table)
        for c in codes[:count].tolist():
            if not before:
                if c >= clear:
                    raise ValueError("a code stream starts with an unknown code")
                before = table[c]
                out.append(before)
                continue
            if c < size:
                entry = table[c]
                fresh = before + entry[:1]
            elif c == size:
                entry = fresh = before + before[:1]
            else:
                raise ValueError("a code is not in the table")
            if size < MOST_CODES:
                table.append(fresh)
                size += 1
            out.append(entry)
            before = entry
        made = sum(map(len, out))
        if len(marks):
            if codes[count] == stop:
                break
            at = int(places[count] + widths[count])
            since, table, before = 0, base[:], b""
        else:
            at = int(places[-1] + widths[-1])
            since += count
    return b"".join(out)[:pixels]


@dataclass(slots=True)
class Frame:
    """One image as it is shown: the whole canvas as RGBA, and where the image itself lies."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray

    @property
    def image(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    rgba = np.full((256, 4), 255, np.uint8)
    rgba[:, :3] = 0
    rgba[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return rgba, at + 3 * n


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order, each drawn over what the disposal of those before it leaves."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, -1
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError("an image is too large")
        own, at = _palette(data, at + 10, packed)
        palette = own if own is not None else shared
        if palette is None:
            raise ValueError("an image has no palette")
        bits = data[at]
        if not 1 <= bits <= 8:
            raise ValueError("a code size is out of range")
        stream, at = _blocks(data, at + 1)
        indices = np.frombuffer(lzw_decode(stream, bits, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if packed & 0x40:  # interlaced: rows come in four passes
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        saved = canvas.copy() if disposal == 3 else None
        h, w = max(0, min(h, height - top)), max(0, min(w, width - left))
        drawn = palette[indices[:h, :w]]
        region = canvas[top : top + h, left : left + w]
        if clear_index >= 0:
            solid = indices[:h, :w] != clear_index
            region[solid] = drawn[solid]
        else:
            region[:] = drawn
        yield Frame(left, top, w, h, delay * 10, disposal, canvas.copy())
        if disposal == 2:
            region[:] = 0
        elif saved is not None:
            canvas = saved
        delay, disposal, clear_index = 0, 0, -1


def histogram(frame: Frame) -> np.ndarray:
    """Pixels of the image in each of 64 colours, two bits for each of red, green and blue."""
    p = frame.image.reshape(-1, 4)
    return np.bincount((p[:, 0] >> 6 << 4) | (p[:, 1] >> 6 << 2) | p[:, 2] >> 6, minlength=HIST_BINS)


def encode_payload(payload: bytes) -> bytes:
    """An animation in 256 greys that holds ``payload``, a multiple of 576 bytes: rows of 576, up to 64 rows a frame."""
    rows = len(payload) // BLOCK
    parts = [b"GIF89a", struct.pack("<HHBBB", BLOCK, min(rows, ROWS), 0xF7, 0, 0), bytes(c for i in range(256) for c in (i, i, i))]
    for top in range(0, rows, ROWS):
        own = payload[top * BLOCK : (top + ROWS) * BLOCK]
        stream = lzw_encode(own)
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY_CS, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, BLOCK, len(own) // BLOCK, 0), b"\x08"]
        parts += [bytes((len(b),)) + b for b in (stream[i : i + 255] for i in range(0, len(stream), 255))] + [b"\0"]
    return b"".join([*parts, b"\x3b"])


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 appended up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


FRAMES = "frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, histogram array<long>, rgba binary, error string"


def frames(media: DataFrame, id_col: str, media_col: str, pixels: bool = True) -> DataFrame:
    """A row for each frame: its time, place, disposal, 64-colour histogram and, with ``pixels``, the canvas as RGBA bytes."""
    source = media.select(F.col(id_col), F.col(media_col).cast("binary").alias("__kindred_media"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, {FRAMES}"

    def rows(key, data):
        if data is None:
            return
        start = 0
        try:
            for i, f in enumerate(decode(data)):
                yield (key, i, start, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, histogram(f).tolist(), f.canvas.tobytes() if pixels else None, None)
                start += f.delay_ms
        except (ValueError, IndexError, struct.error) as e:
            yield (key, None, start, *[None] * 8, str(e) or "cut off")

    def run(batches):
        names = [id_col, *(c.split()[0] for c in FRAMES.split(", "))]
        for b in batches:
            types = [b.schema.types[0], pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.list_(pa.int64()), pa.binary(), pa.string()]
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                for row in rows(key, data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names)

    return source.mapInArrow(lean(run), schema)


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(raw: bytes) -> tuple:
    """The payload of one text, stored as an animation, read back, and described by what was read."""
    medium = encode_payload(padded(raw))
    back, hist, ms, n = [], np.zeros(HIST_BINS, np.int64), 0, 0
    for f in decode(medium):
        back.append(f.image[:, :, 0].tobytes())
        hist += histogram(f)
        ms += f.delay_ms
        n += 1
    payload = b"".join(back)
    feature = f"frames={n};ms={ms};colours=" + ",".join(f"{i}:{c}" for i, c in enumerate(hist.tolist()) if c)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(medium), hashlib.sha256(medium).hexdigest(), feature


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its text stored as a GIF and read back, with the features of its frames."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__kindred_raw"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, {STORED}"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(stored(raw.as_py()) for raw in b.column(1)))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [id_col, *(c.split()[0] for c in STORED.split(", "))])

    return source.mapInArrow(run, schema)
