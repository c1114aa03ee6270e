"""The GIF codec by round trips and by hand-made streams, and the columns made from it."""

import hashlib
import zlib

import numpy as np
import pytest

from nearloom.llm import gif, media


@pytest.mark.parametrize("data", [b"a" * 64, bytes(range(256)) * 40, np.random.default_rng(0).bytes(64 * 2500), b"the cat and the hat " * 16 * 300, b"\0" * 64 * 1025])
def test_round_trip(data):
    assert gif.stored_samples(gif.encode(data)) == data


def _stream(frames, size, palette):
    le = lambda *x: b"".join(v.to_bytes(2, "little") for v in x)
    out = [b"GIF89a", le(*size), b"\xf1\0\0", bytes(palette)]
    for x, y, w, h, samples, delay, disposal, transparent, interlaced in frames:
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (transparent is not None)]), le(delay), bytes([transparent or 0, 0]), b"\x2c", le(x, y, w, h), bytes([0x40 * interlaced, 8]), gif._sub_blocks(gif.lzw_encode(bytes(samples)))]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_interlacing():
    palette = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    data = _stream([(0, 0, 2, 2, [1, 1, 1, 1], 10, 1, None, 0), (0, 0, 2, 1, [2, 3], 20, 2, 3, 0), (1, 1, 1, 1, [3], 30, 3, None, 0), (0, 0, 1, 1, [2], 5, 0, None, 0)], (2, 2), palette)
    f = gif.decode(data)
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].canvas.tolist() == [[red, red], [red, red]]
    assert f[1].canvas.tolist() == [[green, red], [red, red]]
    assert f[2].canvas.tolist() == [[none, none], [red, blue]]  # the second frame's rectangle was cleared
    assert f[3].canvas.tolist() == [[green, none], [red, red]]  # the third frame was taken back
    rows = [[r] for r in range(4)] * 3
    order = [*range(0, 12, 8), *range(4, 12, 8), *range(2, 12, 4), *range(1, 12, 2)]
    woven = _stream([(0, 0, 1, 12, [rows[i][0] for i in order], 0, 0, None, 1)], (1, 12), palette)
    assert gif.decode(woven)[0].canvas[:, 0, :3].tolist() == [palette[3 * r[0] : 3 * r[0] + 3] for r in rows]


def test_late_clear_and_broken_streams():
    with pytest.raises(ValueError):
        gif.decode(b"no gif")
    data = bytes(np.random.default_rng(1).integers(0, 256, 64 * 200, dtype=np.uint8))
    cut = gif.lzw_encode(data)[:-500]
    assert data.startswith(gif.lzw_decode(cut, 8, len(data)))


def test_sizes_are_bounded_and_frames_come_one_by_one():
    huge = b"GIF89a" + b"\xff\xff\xff\xff" + b"\0\0\0"
    with pytest.raises(ValueError, match="pixels"):
        gif.decode(huge)
    stream = gif.frames(gif.encode(b"ab" * 32 * 3, rows=1)[:-1] + b"junk")
    assert [next(stream).canvas.shape for _ in range(3)] == [(1, 64, 4)] * 3
    with pytest.raises((ValueError, IndexError)):
        list(stream)


def test_columns(spark, docs, awkward):
    by = {}
    for r in media.texts_as_gif(docs).collect():
        by.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by.values())
    for i, t in awkward:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        got = next(iter(by[i]))
        assert got[:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and got[6]
    assert media.texts_as_gif(docs.limit(0)).count() == 0
    streams = spark.createDataFrame([(1, gif.encode(b"ab" * 64, rows=1)), (2, b"junk"), (3, None)], "id long, media binary")
    rows = media.gif_frames(streams, "id", "media").orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.start_ms) for r in rows if r.id == 1] == [(1, 0, 0), (1, 1, 40)]
    assert sum(rows[-1].histogram or []) == 0 and all(r.error for r in rows if r.id > 1)
    assert sum(rows[0].histogram) == 64
