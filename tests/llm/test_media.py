import hashlib
import struct
import zlib

import numpy as np
import pytest
from cases import crowded, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import media as M


def test_texts_come_back(spark):
    docs = frame(spark)
    got = M.text_media(crowded(docs)).collect()
    want = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        padded = data.ljust(max(192, -(-len(data) // 192) * 192))
        want.append((str(r["doc_id"]), len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    for r in got:
        assert sum(map(int, r["feature"].split(","))) == r["payload_bytes"]
        assert r["n_frames"] == -(-r["payload_bytes"] // (192 * 256)) and r["duration_ms"] == 100 * r["n_frames"]
    frames = M.timed_frames(M.encode_texts(docs)).where("doc_id = 5").orderBy("frame").collect()
    assert [f["start_ms"] for f in frames] == [100 * k for k in range(len(frames))] and len(frames) > 3


def test_empty_table(spark):
    assert M.text_media(frame(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(1, 60))
def test_lzw_round_trip(data, times):
    data = data * times
    assert M.lzw_decode(M.lzw_encode(data), 8, len(data)) == data


def test_long_random_stream():
    data = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert M.lzw_decode(M.lzw_encode(data), 8, len(data)) == data


def plain_codes(codes, minimum, cap=12):
    """A code stream written one code at a time; widths follow the table a reader would have."""
    bits, width, size, fresh = "", minimum + 1, (1 << minimum) + 2, True
    for c in codes:
        bits = format(c, f"0{width}b") + bits
        if c == 1 << minimum:
            width, size, fresh = minimum + 1, (1 << minimum) + 2, True
            continue
        if not fresh and size < 4096:
            size += 1
        fresh = False
        if size == 1 << width and width < cap:
            width += 1
    bits = bits.zfill(-(-len(bits) // 8) * 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "little")


def test_streams_of_other_writers():
    literal = [256, *[i % 256 for i in range(9000)], 257]  # never cleared: the table fills and is kept
    assert M.lzw_decode(plain_codes(literal, 8), 8, 9000) == bytes(i % 256 for i in range(9000))
    early = [4, 1, 2, 4, 4, 3, 3, 5]
    assert M.lzw_decode(plain_codes(early, 2), 2, 4) == bytes([1, 2, 3, 3])
    assert M.lzw_decode(plain_codes([4, 1, 6, 6, 5], 2), 2, 5) == bytes([1] * 5)  # an entry used as it is made
    for bad in ([4, 7, 5], [4, 1, 9]):
        with pytest.raises(M.BadImage):
            M.lzw_decode(plain_codes(bad, 3 if 9 in bad else 2), 2, 9)


def gif(frames, size=(4, 4), colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(sum(colours, ()))
    for rect, pixels, disposal, clear, flags, local in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0)
        out += struct.pack("<BHHHHB", 0x2C, *rect, flags) + local
        out += b"\x02" + M.sub_blocks(plain_codes([x for p in pixels for x in (4, p)] + [5], 2))
    return out + b"\x3b"


def shown(data):
    return [(f.canvas.copy(), f.delay) for f in M.decode_frames(data)]


def test_palettes_disposal_and_transparency():
    whole, part = (0, 0, 4, 4), (1, 1, 2, 2)
    white = bytes([9, 9, 9] * 3 + [255, 255, 255])
    data = gif([(whole, [1] * 16, 1, None, 0, b""), (part, [2, 0, 0, 2], 2, 0, 0, b""), (part, [3] * 4, 3, None, 0x81, white), ((0, 0, 1, 1), [2], 0, None, 0, b"")])
    (a, d), (b, _), (c, _), (e, _) = shown(data)
    assert d == 7 and (a[..., :3] == [255, 0, 0]).all() and (a[..., 3] == 255).all()
    assert b[1, 1].tolist() == [0, 255, 0, 255] and b[1, 2].tolist() == [255, 0, 0, 255]  # transparent pixels leave what was there
    assert c[1, 1].tolist() == [255] * 4 and c[0, 0].tolist() == [255, 0, 0, 255]  # own palette
    assert e[1, 1].tolist() == [0, 0, 0, 0] and e[0, 0].tolist() == [0, 255, 0, 255]  # back to before the third, after the second was cleared
    assert M.histogram(e)[12] == 1 and M.histogram(e)[48] == 11


def test_interlaced_rows_and_broken_files():
    rows = [[k % 4] * 4 for k in (0, 2, 1, 3)]  # passes of a height of four: rows 0, 2, 1, 3
    (canvas, _), = shown(gif([((0, 0, 4, 4), sum(rows, []), 0, None, 0x40, b"")]))
    assert canvas[:, 0, :3].tolist() == [[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]
    good = M.store_payload("x" * 1000)[1]
    for bad in (good[:-30], good[:5], b"PNG" + good, good[:20]):
        with pytest.raises(M.BadImage):
            list(M.decode_frames(bad))


def test_bad_files_are_rows_with_an_error(spark):
    good = M.store_payload("x" * 60_000)[1]
    huge = good[:6] + struct.pack("<HH", 65_535, 65_535) + good[10:]
    wide = good.replace(struct.pack("<BHHHHB", 0x2C, 0, 0, 192, 256, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, 65_535, 65_535, 0), 1)
    rows = [(1, 5, good), (2, 5, huge), (3, 5, good[:-40]), (4, 5, b""), (5, 5, wide)]
    files = spark.createDataFrame([(k, n, bytearray(d)) for k, n, d in rows], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r["doc_id"]: r for r in M.media_features(files).collect()}
    assert got[1]["error"] is None and got[1]["n_frames"] == 2
    for k, _, data in rows[1:]:
        assert got[k]["error"] and got[k]["feature"] is None and got[k]["payload_sha256"] is None and got[k]["media_bytes"] == len(data)
    frames = [(r["doc_id"], r["frame"]) for r in M.timed_frames(files).orderBy("doc_id", "start_ms").collect() if r["error"] is None]
    assert frames == [(1, 0), (1, 1), (3, 0)]
    assert {r["doc_id"] for r in M.timed_frames(files).where("error is not null").collect()} == {2, 3, 4, 5}
