"""PNG, decoded and encoded with numpy.

Decoding takes gray, RGB, palette and alpha images of 1 to 16 bits a sample, all
row filters and Adam7 interlacing; alpha is dropped and of 16 bits the higher eight
are kept. A byte depends on its left, upper and upper left neighbours, so the filters
are undone along the image's diagonals, each of which is one array operation.
Damaged files, with a wrong check sum too, raise ``PngError``. Encoding picks for
each row the filter with the least sum of absolute differences.
"""

from __future__ import annotations

import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type, and the passes of Adam7 as first column, first row and their steps.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: The most pixels that are decoded; a header may declare any number.
MOST_PIXELS = 1 << 28


class PngError(ValueError):
    """The file is damaged or of a kind that isn't read."""


def _chunks(data: bytes):
    if not data.startswith(SIGNATURE):
        raise PngError("not a PNG file")
    at = len(SIGNATURE)
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) != 4 or zlib.crc32(kind + body) != int.from_bytes(check):
            raise PngError("a chunk is cut off or has a wrong check sum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise PngError("the end is missing")


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one nearest to left + up - corner; in doubt in this order."""
    to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def unfilter(rows: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Undo the filters of byte rows, of which ``step`` bytes make a pixel."""
    h, n = rows.shape
    columns = -(-n // step)
    out = np.zeros((h + 1, columns + 1, step), np.int64)  # a row and a column of zeros before the image
    given = np.zeros((h, columns * step), np.int64)
    given[:, :n] = rows
    given = given.reshape(h, columns, step)
    if filters.max(initial=0) < 3:
        return _unfilter_rows(given, filters)[:, :n]
    for d in range(h + columns - 1):
        y = np.arange(max(0, d - columns + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        kind = filters[y][:, None]
        guess = np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, _nearest(left, up, corner)])
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, -1)[:, :n].astype(np.uint8)


def _unfilter_rows(given: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Where no row uses the average or the nearest neighbour: sums along a row or down."""
    out, above = np.empty(given.shape, np.int64), np.zeros(given.shape[1:], np.int64)
    for y, kind in enumerate(filters.tolist()):
        above = (np.cumsum(given[y], axis=0) if kind == 1 else given[y] + above if kind == 2 else given[y]) & 255
        out[y] = above
    return out.reshape(len(given), -1).astype(np.uint8)


def _samples(data: bytes, w: int, h: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """One pass as (height, width, channels), and the bytes that it took."""
    if not w or not h:
        return np.zeros((h, w, channels), np.uint8), 0
    line = -(-w * channels * depth // 8)
    if len(data) < h * (line + 1):
        raise PngError("pixels are missing")
    rows = np.frombuffer(data, np.uint8, h * (line + 1)).reshape(h, line + 1)
    if rows[:, 0].max() > 4:
        raise PngError("no such filter")
    rows_ = unfilter(rows[:, 1:], rows[:, 0], max(1, channels * depth // 8))
    if depth == 16:
        rows_ = rows_[:, 0::2]
    elif depth < 8:
        bits = np.unpackbits(rows_, axis=1).reshape(h, -1, depth)
        rows_ = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)
    return rows_[:, : w * channels].reshape(h, w, channels), h * (line + 1)


def decode_png(data: bytes) -> np.ndarray:
    """Pixels as (height, width, 3) in BGR, or (height, width, 1) if gray."""
    header, palette, stored = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR" and len(body) == 13:
            header = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            stored.append(body)
    if header is None:
        raise PngError("the header is missing")
    w, h = int.from_bytes(header[:4]), int.from_bytes(header[4:8])
    depth, colour, interlaced = header[8], header[9], header[12]
    depths = {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(colour, (8, 16))
    if colour not in CHANNELS or depth not in depths or interlaced > 1 or header[10] or header[11] or not 0 < w * h <= MOST_PIXELS:
        raise PngError("no such kind of image")
    channels = CHANNELS[colour]
    try:
        # no more is inflated than the image can need, whatever the stream holds
        flat = zlib.decompressobj().decompress(b"".join(stored), (w * channels * depth // 8 + 2) * h + (w + h) * 16 + (w * h if interlaced else 0))
    except zlib.error as error:
        raise PngError("the pixels can't be inflated") from error
    if interlaced:
        pixels = np.zeros((h, w, channels), np.uint8)
        for x, y, dx, dy in PASSES:
            part, used = _samples(flat, len(range(x, w, dx)), len(range(y, h, dy)), depth, channels)
            pixels[y::dy, x::dx], flat = part, flat[used:]
    else:
        pixels, _ = _samples(flat, w, h, depth, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise PngError("a colour is missing")
        return np.ascontiguousarray(palette[pixels[:, :, 0]][:, :, ::-1])
    if depth < 8:
        pixels = pixels * np.uint8(255 // ((1 << depth) - 1))
    return np.ascontiguousarray(pixels[:, :, :3][:, :, ::-1] if channels >= 3 else pixels[:, :, :1])


def filtered(rows: np.ndarray, step: int) -> np.ndarray:
    """All five filters of byte rows, as (filter, row, byte)."""
    now = rows.astype(np.int64)
    pad = np.pad(now, ((1, 0), (step, 0)))
    left, up, corner = pad[1:, :-step], pad[:-1, step:], pad[:-1, :-step]
    return np.stack([now, now - left, now - up, now - (left + up >> 1), now - _nearest(left, up, corner)]) & 255


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)


def encode_png(array: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit gray or RGB file of a (height, width, 1 or 3) array."""
    h, w, channels = array.shape
    if channels not in (1, 3) or not h or not w:
        raise PngError("an image of this size or number of channels can't be written")
    rows = np.ascontiguousarray(array[:, :, ::-1], np.uint8).reshape(h, -1)
    tried = filtered(rows, channels)
    best = np.minimum(tried, 256 - tried).sum(2).argmin(0)
    lines = np.concatenate([best[:, None], tried[best, np.arange(h)]], 1).astype(np.uint8)
    header = w.to_bytes(4) + h.to_bytes(4) + bytes([8, 2 if channels == 3 else 0, 0, 0, 0])
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")
