"""A GIF codec: LZW code streams, palettes, disposal, transparency, interlacing, timed frames.

``decode`` reads any GIF87a or GIF89a stream into timed frames (the composed canvas after each
image); ``encode`` writes 8-bit samples as greyscale frames.  Code widths depend only on how many
codes have passed since the last clear code, so whole runs of codes are unpacked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Codes between two clear codes when the table of 4,096 strings fills up (8-bit samples).
_FULL = 4096 - 258


def _widths(n: int, least: int) -> np.ndarray:
    """Bits of codes 0..n-1 after a clear code, at ``least`` bits per sample."""
    have = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(have)).astype(np.int64) + 1, 12)


_W8 = _widths(_FULL + 1, 8)


def lzw_encode(samples: bytes) -> bytes:
    """The LZW code stream of 8-bit samples, with a clear code whenever the table is full."""
    codes: list[int] = []
    emit = codes.append
    table: dict[int, int] = {}
    marks: list[int] = []  # where each segment starts
    if samples:
        marks.append(0)
        p, n = samples[0], 258
        get = table.get
        for c in memoryview(samples)[1:]:
            k = p << 8 | c
            q = get(k)
            if q is None:
                emit(p)
                table[k] = n
                n += 1
                p = c
                if n == 4096:
                    table.clear()
                    n = 258
                    marks.append(len(codes))
            else:
                p = q
        emit(p)
    ends = [*marks[1:], len(codes)]
    all_codes, widths = [np.array([256])], [np.array([9])]
    have = np.array(codes, np.int64)
    for a, b in zip(marks, ends, strict=True):
        last = b == len(codes)
        w = _W8[: b - a + 1]
        all_codes += [have[a:b], np.array([257 if last else 256])]
        widths.append(w)
    if not marks:
        all_codes.append(np.array([257]))
        widths.append(np.array([9]))
    c, w = np.concatenate(all_codes), np.concatenate(widths)
    bits = (c[:, None].astype(np.uint16) >> np.arange(12, dtype=np.uint16)).astype(np.uint8) & 1
    return np.packbits(bits[np.arange(12) < w[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; it may end early or lack its end code."""
    clear, end = 1 << least, (1 << least) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at = 8 * len(stream), 0
    run = np.concatenate([[0], np.cumsum(_widths(8192, least))])
    base: list[bytes] = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made = 0
    table, prev = base.copy(), b""
    since = 0  # codes since the last clear code
    while at < total and made < most:
        if since + 1 >= len(run):
            run = np.concatenate([run, run[-1] + 12 * np.arange(1, 8193)])
        offs = at + run[since:] - run[since]
        n = int(np.searchsorted(offs[1:], total, "right"))
        if not n:
            break
        offs = offs[: n + 1]
        byte, shift = offs[:-1] >> 3, offs[:-1] & 7
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> shift & ((1 << np.diff(offs)) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stop[0]) if len(stop) else n
        for c in codes[:upto].tolist():
            if not prev:
                if c >= clear:
                    raise ValueError("a code stream starts with a code that is no sample")
                prev = table[c]
                out.append(prev)
                made += 1
                continue
            if c < len(table):
                entry = table[c]
            elif c == len(table):
                entry = prev + prev[:1]
            else:
                raise ValueError("a code is beyond the table")
            out.append(entry)
            made += len(entry)
            if len(table) < 4096:
                table.append(prev + entry[:1])
            prev = entry
        if not len(stop):
            at, since = int(offs[n]), since + n
            continue
        if codes[upto] == end:
            break
        at, since, prev = int(offs[upto + 1]), 0, b""
        table = base.copy()
    return b"".join(out)[:most]


@dataclass
class Frame:
    """One image: its rectangle, the canvas after it (RGBA) and how long it shows (1/100 s)."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray = field(repr=False)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


#: A canvas or an image of more pixels (256 MB) is refused before any memory is taken for it.
MOST_PIXELS = 1 << 26


def _bounded(w: int, h: int) -> None:
    if w * h > MOST_PIXELS:
        raise ValueError(f"{w} x {h} pixels are more than {MOST_PIXELS}")


def decode(data: bytes) -> list[Frame]:
    """All frames, each with the whole canvas as it shows after that image was drawn."""
    return list(frames(data))


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of ``decode``, one at a time; an error comes where the stream breaks."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    w, h = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    _bounded(w, h)
    at, shared = 13, None
    if data[10] & 0x80:
        n = 2 << (data[10] & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
    canvas = np.zeros((h, w), np.uint32)  # RGBA, a pixel in one number
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, int.from_bytes(block[1:3], "little")
                transparent = block[3] if block[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        x, y, fw, fh = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
        _bounded(fw, fh)
        flags, palette = data[at + 9], shared
        at += 10
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
            at += 3 * n
        least = data[at]
        stream, at = _blocks(data, at + 1)
        got = lzw_decode(stream, least, fw * fh)
        index = np.zeros(fw * fh, np.uint8)
        index[: len(got)] = np.frombuffer(got, np.uint8)
        index = index.reshape(fh, fw)
        seen = np.arange(fw * fh).reshape(fh, fw) < len(got)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, fh, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight, known = np.empty_like(index), np.empty_like(seen)
            straight[order], known[order] = index, seen
            index, seen = straight, known
        if palette is None:
            raise ValueError("no palette")
        padded = np.zeros((256, 4), np.uint8)
        padded[: len(palette), :3], padded[:, 3] = palette, 255
        colours = padded.view(np.uint32)[:, 0]
        before = canvas.copy() if disposal == 3 else None
        shown = seen if transparent is None else seen & (index != transparent)
        part = canvas[y : y + fh, x : x + fw]
        shown, index = shown[: part.shape[0], : part.shape[1]], index[: part.shape[0], : part.shape[1]]
        if shown.all():
            part[:] = colours[index]
        else:
            part[shown] = colours[index[shown]]
        yield Frame(x, y, fw, fh, delay, disposal, transparent, canvas.copy().view(np.uint8).reshape(h, w, 4))
        if disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def _sub_blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (stream[i : i + 255] for i in range(0, len(stream), 255))) + b"\0"


def encode(payload: bytes, width: int = 64, rows: int = 1024, delay: int = 4) -> bytes:
    """8-bit samples as a greyscale animation: ``width`` samples a row, ``rows`` rows a frame."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    high = min(rows, len(payload) // width)
    le = lambda *x: b"".join(v.to_bytes(2, "little") for v in x)
    out = [b"GIF89a", le(width, high), b"\xf7\0\0", GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for a in range(0, len(payload), width * rows):
        part = payload[a : a + width * rows]
        out += [b"\x21\xf9\x04\x04", le(delay), b"\0\0\x2c", le(0, 0, width, len(part) // width), b"\0\x08", _sub_blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def stored_samples(data: bytes) -> bytes:
    """The samples of a stream made by ``encode``, read back through palette and canvas."""
    return b"".join(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes() for f in frames(data))


def histogram(canvas: np.ndarray, bins: int = 4) -> list[int]:
    """Counts of the visible pixels in ``bins`` equal steps of red, green and blue."""
    shown = canvas[canvas[..., 3] > 0][:, :3].astype(np.int64) * bins >> 8
    return np.bincount(shown @ np.array([bins * bins, bins, 1]), minlength=bins**3).tolist()
