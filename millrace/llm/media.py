"""Animated GIF as a media column: encoding, decoding and colour histograms.

The decoder reads LZW code streams of any writer (variable code width, clear
codes early, late or never), global and local palettes, interlaced rows,
transparency, and the disposal rules keep, background and previous; it gives
timed frames as whole canvases. Codes are unpacked in numpy, since the width of
a code depends only on its place after the last clear code.

Payloads are stored as 8-bit samples: rows of 192 palette indices, up to
``FRAME_ROWS`` of them in a frame, as many frames as it takes. The palette is a
bijection on its red channel, so samples can be read back from the canvas.

Defined results: a null text is empty and is stored as one row of spaces; a
text of any length takes more frames, one at a time; equal texts have equal
files; media that break the format raise :class:`BadImage`.
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

from millrace.llm.runtime import cut, prepare

WIDTH = 192
FRAME_ROWS = 256
DELAY = 10  # hundredths of a second
MOST_PIXELS = 1 << 26  # of a canvas or image: 256 MB as decoded
CLEAR, STOP = 256, 257

_INDEX = np.arange(256)
PALETTE = np.stack([_INDEX, (_INDEX * 37 + 11) % 256, (_INDEX * 101 + 53) % 256], axis=1).astype(np.uint8)


class BadImage(ValueError):
    """A file that breaks the format."""


def _widths(minimum: int) -> np.ndarray:
    """Width of each code after a clear code; 12 bits for all beyond."""
    first = (1 << minimum) + 2
    held = first + np.maximum(np.arange(4200) - 1, 0)
    return np.minimum(12, np.maximum(minimum + 1, np.ceil(np.log2(held + 1)))).astype("i8")


_WIDTHS = {m: _widths(m) for m in range(2, 9)}
_PLACES = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in _WIDTHS.items()}


def lzw_encode(data: bytes) -> bytes:
    """An 8-bit code stream; the table is cleared when it is full."""
    out, runs = [CLEAR], []
    table: dict[int, int] = {}
    add, find, size, w = out.append, table.get, 258, data[0]
    for b in data[1:]:
        key = w << 8 | b
        code = find(key)
        if code is not None:
            w = code
            continue
        add(w)
        if size < 4096:
            table[key] = size
            size += 1
        else:
            add(CLEAR)
            runs.append(len(out))
            table.clear()
            size = 258
        w = b
    add(w)
    add(STOP)
    codes = np.array(out, np.uint16)
    place = np.arange(len(codes)) - 1  # the first clear code is as wide as what follows it
    for r in runs:
        place[r:] = np.arange(len(codes) - r)
    widths = _WIDTHS[8][np.maximum(place, 0)]
    bits = (codes[:, None] >> np.arange(12, dtype=np.uint16) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, minimum: int, pixels: int) -> bytes:
    """The indices of a code stream."""
    if not 2 <= minimum <= 8:
        raise BadImage(f"code size {minimum}")
    clear, stop = 1 << minimum, (1 << minimum) + 1
    total_bits = 8 * len(stream)
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    windows = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    have, bit = 0, 0
    table, last = list(singles), None
    read = 0  # codes since the last clear code
    while have < pixels:
        places = _PLACES[minimum]
        if read + 4096 >= len(places):  # a full table that is kept: 12 bits each
            steps = 12 * np.arange(4097)
        else:
            steps = places[read:] - places[read]
        widths = np.diff(steps)
        ends = bit + steps[1:]
        n = int(np.searchsorted(ends, total_bits, side="right"))
        if not n:
            raise BadImage("the code stream is cut")
        at = bit + steps[:n]
        codes = (windows[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        end = int(marks[0]) if len(marks) else n
        for code in codes[:end].tolist():
            if last is None:
                if code >= clear:
                    raise BadImage("a code before its entry")
                entry = singles[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table) and len(table) < 4096:
                    entry = last + last[:1]
                else:
                    raise BadImage("a code before its entry")
                if len(table) < 4096:
                    table.append(last + entry[:1])
            out.append(entry)
            last = entry
        have = sum(map(len, out)) if have == 0 else have + sum(map(len, out[-end:] if end else []))
        if len(marks):
            bit = int(ends[end])
            if codes[end] == stop:
                break
            table, last, read = list(singles), None, 0
        else:
            bit = int(ends[n - 1])
            read += n
    return b"".join(out)[:pixels]


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_frames(images: list[np.ndarray], delay: int = DELAY) -> bytes:
    """A file of frames of palette indices, all from the upper left corner."""
    height = max(len(x) for x in images)
    parts = [b"GIF89a", struct.pack("<HHBBB", images[0].shape[1], height, 0xF7, 0, 0), PALETTE.tobytes()]
    if len(images) > 1:
        parts.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for x in images:
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        parts.append(struct.pack("<BHHHHB", 0x2C, 0, 0, x.shape[1], x.shape[0], 0))
        parts.append(b"\x08" + sub_blocks(lzw_encode(x.tobytes())))
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    """A canvas (height, width, RGBA) as shown for ``delay`` hundredths of a second, and the part that was drawn."""

    canvas: np.ndarray
    delay: int
    disposal: int
    left: int
    top: int
    width: int
    height: int

    @property
    def drawn(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def decode_frames(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames of a file, one at a time. A frame's canvas is valid until the next is asked for.

    A file whose canvas or images have more than ``most_pixels`` is bad: its header alone would take that memory.
    """
    try:
        yield from _decode(data, most_pixels)
    except (IndexError, struct.error) as e:
        raise BadImage("the file is cut") from e


def _decode(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise BadImage("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette_at(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise BadImage("the palette is cut")
        table = np.zeros((256, 3), np.uint8)
        table[:n] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3)
        return table, at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            if at + 1 + n >= len(data):
                raise BadImage("the file is cut")
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if width * height > most_pixels:
        raise BadImage(f"a canvas of {width} x {height}")
    shared, at = palette_at(flags, at)
    canvas = np.zeros((height, width, 4), np.uint8)
    control = (0, 0, None)  # disposal, delay, transparent index
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9:
                packed, delay, clear = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, clear if packed & 1 else None)
            at = after
            continue
        if kind != 0x2C:
            raise BadImage(f"block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = palette_at(flags, at + 10)
        palette = own if own is not None else shared
        if palette is None:
            raise BadImage("no palette")
        if w * h > most_pixels:
            raise BadImage(f"an image of {w} x {h}")
        stream, after = blocks(at + 1)
        indices = np.frombuffer(lzw_decode(stream, data[at], w * h), np.uint8)
        if len(indices) < w * h:
            raise BadImage("too few pixels")
        at = after
        image = indices.reshape(h, w)
        if flags & 0x40:  # rows in four passes
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(image)
            straight[rows] = image
            image = straight
        disposal, delay, clear = control
        before = canvas.copy() if disposal == 3 else None
        shown = canvas[top : top + h, left : left + w]
        image = image[: shown.shape[0], : shown.shape[1]]
        if clear is None:
            shown[..., :3] = palette[image]
            shown[..., 3] = 255
        else:
            seen = image != clear
            shown[seen, :3] = palette[image[seen]]
            shown[seen, 3] = 255
        yield Frame(canvas, delay, disposal, left, top, shown.shape[1], shown.shape[0])
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif before is not None:
            canvas = before
        control = (0, 0, None)


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of visible pixels in 64 colour cells, two bits of each channel."""
    seen = pixels[..., 3] > 0
    p = pixels[seen] >> 6
    return np.bincount(p[:, 0].astype("i8") * 16 + p[:, 1] * 4 + p[:, 2], minlength=64)


def store_payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, file that holds it padded to rows)."""
    data = (text or "").encode()
    rows = max(1, -(-len(data) // WIDTH))
    samples = np.frombuffer(data.ljust(rows * WIDTH), np.uint8).reshape(rows, WIDTH)
    return len(data), encode_frames([samples[i : i + FRAME_ROWS] for i in range(0, rows, FRAME_ROWS)])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media). No shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                stored = [store_payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in stored], pa.int64()), pa.array([m for _, m in stored], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def timed_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame: when it shows, for how long, where it was drawn, and the canvas's colour histogram.

    A bad file has a last row with an ``error`` and no values, after the frames that could be read.
    """
    prepare(media.sparkSession)

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clock, out = 0, []
                try:
                    for k, f in enumerate(decode_frames(data)):
                        out.append({"doc_id": key, "frame": k, "start_ms": clock, "delay_ms": 10 * f.delay, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "histogram": histogram(f.canvas).tolist()})
                        clock += 10 * f.delay
                except BadImage as e:
                    out.append({"doc_id": key, "error": str(e)})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("frame", "start_ms", "delay_ms", "left", "top", "width", "height")), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), media_col).where(F.col(media_col).isNotNull())
    return rows.mapInArrow(run, "doc_id long, frame long, start_ms long, delay_ms long, left long, top long, width long, height long, histogram array<long>, error string")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back through the decoder: checksums of payload and file, and the histogram over frames.

    A bad file has an ``error``, its own length and checksum, and nulls.
    """
    prepare(media.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("duration_ms", pa.int64()), ("feature", pa.string()), ("error", pa.string())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for key, n, data in zip(*(part.column(i).to_pylist() for i in range(3))):
                    sha, tail, size, clock, frames, cells = hashlib.sha256(), b"", 0, 0, 0, np.zeros(64, "i8")
                    stored = len(data), hashlib.sha256(data).hexdigest()
                    try:
                        for f in decode_frames(data):
                            samples = f.drawn[..., 0].tobytes()
                            sha.update(samples)
                            tail, size, clock, frames = (tail + samples)[-16:], size + len(samples), clock + 10 * f.delay, frames + 1
                            cells += histogram(f.drawn)
                    except BadImage as e:
                        out.append((key, n, None, None, None, *stored, None, None, None, str(e)))
                        continue
                    out.append((key, n, size, sha.hexdigest(), zlib.crc32(tail), *stored, frames, clock, ",".join(map(str, cells)), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in the shared folder and compute features from the stored files."""
    return media_features(cut(encode_texts(docs, id_col, text_col), "media"))
