"""Baseline JPEG (ITU-T T.81) with JFIF colours, decoded and encoded with numpy.

Decoding takes 8-bit baseline and extended sequential Huffman streams of one or
three components in one scan, any sampling factors whose ratios are whole, and
restart intervals. Half-size chroma is enlarged by the triangle filter that common
decoders use, other ratios by repetition; an EXIF orientation is applied. Only the
walk along the Huffman codes is a Python loop, a step for each code; coefficients,
transforms, sampling and colours are arrays. Progressive, lossless, arithmetic and
twelve-bit files, four components and damaged files raise ``JpegError``.

Encoding writes baseline files with Huffman codes made for each image, 4:4:4 or
4:2:0, and restart markers on request. Results are within rounding of other
implementations; equality to the last bit isn't claimed.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the standard: the quantisation tables of its Annex K for luminance and chrominance, by rows.
LUMINANCE = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMINANCE = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""
#: Frames that are read: baseline and extended sequential, Huffman coded; all other frame markers are refused.
SEQUENTIAL, OTHER_FRAMES = {0xC0, 0xC1}, {0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
#: The most pixels that are decoded; a header may declare any number.
MOST_PIXELS = 1 << 28


class JpegError(ValueError):
    """The file is damaged or of a kind that isn't read."""


def _zigzag() -> np.ndarray:
    """The order in which a block's coefficients are stored, as places in rows."""
    places = [(r, c) for r in range(8) for c in range(8)]
    # along the diagonals, alternately upwards and downwards
    places.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in places])


def _cosines() -> np.ndarray:
    """The orthonormal transform: rows are frequencies."""
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis


ZIGZAG, COSINES = _zigzag(), _cosines()


# decoding


@dataclass
class _Component:
    number: int
    across: int
    down: int
    table: int
    codes: tuple[int, int] = (0, 0)


@dataclass
class _Header:
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, list] = field(default_factory=dict)
    components: list[_Component] = field(default_factory=list)
    height: int = 0
    width: int = 0
    restart: int = 0
    orientation: int = 1
    transform: int | None = None


@functools.lru_cache(64)
def _code_table(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """For each 16 bits that may come next, the code's length and symbol."""
    table: list[tuple[int, int] | None] = [None] * (1 << 16)
    code = at = 0
    for length, many in enumerate(counts, 1):
        for _ in range(many):
            if code >= 1 << length or at >= len(symbols):
                raise JpegError("a code table overflows")
            first = code << 16 - length
            table[first : first + (1 << 16 - length)] = [(length, symbols[at])] * (1 << 16 - length)
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _orientation(body: bytes) -> int:
    """The orientation that an EXIF segment gives; 1 if it gives none."""
    if not body.startswith(b"Exif\0\0") or body[6:8] not in (b"II", b"MM"):
        return 1
    tiff, order = body[6:], "little" if body[6:8] == b"II" else "big"
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    first = number(4, 4)
    for k in range(number(first, 2)):
        at = first + 2 + 12 * k
        if number(at, 2) == 0x0112:
            return number(at + 8, 2) if 1 <= number(at + 8, 2) <= 8 else 1
    return 1


def _read_header(data: bytes) -> tuple[_Header, int]:
    """Everything before the scan, and where its coded data begin."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG file")
    header, at = _Header(), 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise JpegError("a segment is cut off")
        at += 2 + size
        if marker in OTHER_FRAMES:
            raise JpegError("not a sequential Huffman frame")
        if marker == 0xDB:
            _read_quantisers(body, header)
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                header.codes[body[0]] = _code_table(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif marker in SEQUENTIAL:
            _read_frame(body, header)
        elif marker == 0xDD:
            header.restart = int.from_bytes(body[:2])
        elif marker == 0xE1:
            header.orientation = _orientation(body)
        elif marker == 0xEE and body.startswith(b"Adobe") and len(body) >= 12:
            header.transform = body[11]
        elif marker == 0xDA:
            _read_scan(body, header)
            return header, at


def _read_quantisers(body: bytes, header: _Header) -> None:
    while body:
        wide, many = body[0] >> 4, 64 << (body[0] >> 4)
        if wide > 1 or len(body) < 1 + many:
            raise JpegError("a quantisation table is cut off")
        values = np.zeros(64)
        values[ZIGZAG] = np.frombuffer(body[1 : 1 + many], ">u2" if wide else np.uint8)
        header.quantisers[body[0] & 15] = values
        body = body[1 + many :]


def _read_frame(body: bytes, header: _Header) -> None:
    if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
        raise JpegError("not an 8-bit frame")
    header.height, header.width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
    header.components = [_Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
    sampled = [c.across in range(1, 5) and c.down in range(1, 5) for c in header.components]
    if len(sampled) not in (1, 3) or not all(sampled) or not 0 < header.height * header.width <= MOST_PIXELS:
        raise JpegError("size, number or sampling of components isn't read")


def _read_scan(body: bytes, header: _Header) -> None:
    named = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
    if len(named) != len(header.components) or not header.components:
        raise JpegError("components in several scans")
    for c in header.components:
        if c.number not in named or c.table not in header.quantisers:
            raise JpegError("a component without tables")
        c.codes = (named[c.number] >> 4, 16 | named[c.number] & 15)
        if any(t not in header.codes for t in c.codes):
            raise JpegError("a component without codes")


def _walk(data: bytes, plan: list[tuple[int, list, list]], units: int, coefficients: list[tuple[list, list]]) -> None:
    """Decode ``units`` units of an interval; ``plan`` names the component and codes of each of a unit's blocks.

    Appends places (64 for each block, in stored order) and values to each component's lists.
    """
    spare = held = at = past = 0
    before = [0] * len(coefficients)
    done = [c[2] for c in coefficients]
    for _ in range(units):
        for component, dc, ac in plan:
            places, values, _ = coefficients[component]
            base = done[component] * 64
            done[component] += 1
            k = 0
            while k < 64:
                if held < 32:
                    more = data[at : at + 6]
                    at += 6
                    if len(more) < 6:
                        past += 6 - len(more)
                        more = more + b"\0" * (6 - len(more))
                    spare = (spare & ((1 << held) - 1)) << 48 | int.from_bytes(more)
                    held += 48
                found = (ac if k else dc)[spare >> held - 16 & 0xFFFF]
                if found is None:
                    raise JpegError("no such code")
                length, symbol = found
                held -= length
                size = symbol & 15 if k else symbol
                if k:
                    k += symbol >> 4
                    if not size:
                        if symbol >> 4 != 15:
                            break
                        k += 1
                        continue
                if size:
                    held -= size
                    value = spare >> held & (1 << size) - 1
                    if not value >> size - 1:
                        value -= (1 << size) - 1
                else:
                    value = 0
                if k > 63 or size > 15:
                    raise JpegError("a block overflows")
                if not k:
                    before[component] = value = before[component] + value
                places.append(base + k)
                values.append(value)
                k += 1
    if past * 8 > held:
        raise JpegError("the coded data end early")
    for k, c in enumerate(coefficients):
        c[2] = done[k]


def _intervals(data: bytes) -> list[bytes]:
    """Coded data between restart markers, up to the marker that ends them, without stuffed bytes."""
    end = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", data)
    coded = data[: end.start()] if end else data
    return [part.replace(b"\xff\x00", b"\xff") for part in re.split(rb"\xff+[\xd0-\xd7]", coded)]


def _planes(header: _Header, data: bytes) -> list[np.ndarray]:
    """The samples of each component as whole blocks."""
    parts = header.components
    if len(parts) == 1:
        parts[0].across = parts[0].down = 1  # the scan of one component has a block a unit
    widest, highest = max(c.across for c in parts), max(c.down for c in parts)
    columns, rows = -(-header.width // (8 * widest)), -(-header.height // (8 * highest))
    plan = [(k, *(header.codes[t] for t in c.codes)) for k, c in enumerate(parts) for _ in range(c.across * c.down)]
    found: list = [[[], [], 0] for _ in parts]
    step = header.restart or columns * rows
    intervals = _intervals(data)
    if len(intervals) < -(-columns * rows // step):
        raise JpegError("the coded data end early")
    for k in range(0, columns * rows, step):
        _walk(intervals[k // step], plan, min(step, columns * rows - k), found)
    planes = []
    for c, (places, values, _) in zip(parts, found, strict=True):
        blocks = np.zeros((columns * rows * c.across * c.down, 64))
        at = np.array(places, np.int64)
        blocks[at // 64, ZIGZAG[at % 64]] = values
        samples = COSINES.T @ (blocks * header.quantisers[c.table]).reshape(-1, 8, 8) @ COSINES
        # rounded first, so that ties don't hang on the last bit of a sum
        samples = np.clip(np.floor(np.round(samples, 6) + 128.5), 0, 255)
        grid = samples.reshape(rows, columns, c.down, c.across, 8, 8).transpose(0, 2, 4, 1, 3, 5)
        planes.append(grid.reshape(rows * c.down * 8, columns * c.across * 8))
    return planes


def _doubled(plane: np.ndarray) -> np.ndarray:
    """Twice the rows, each of three quarters of the nearer row and one of the further."""
    edge = np.pad(plane, ((1, 1), (0, 0)), mode="edge")
    out = np.empty((2 * len(plane), plane.shape[1]))
    out[0::2] = (3 * plane + edge[:-2]) / 4
    out[1::2] = (3 * plane + edge[2:]) / 4
    return out


def _enlarged(plane: np.ndarray, down: int, across: int) -> np.ndarray:
    plane = _doubled(plane) if down == 2 else np.repeat(plane, down, 0)
    return _doubled(plane.T).T if across == 2 else np.repeat(plane, across, 1)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Pixels as (height, width, 3) in BGR, or (height, width, 1) if there is one component."""
    try:
        header, at = _read_header(data)
        planes = _planes(header, data[at:])
    except IndexError as error:
        raise JpegError("a segment is cut off") from error
    widest, highest = (max(getattr(c, s) for c in header.components) for s in ("across", "down"))
    whole = []
    for c, plane in zip(header.components, planes, strict=True):
        if widest % c.across or highest % c.down:
            raise JpegError("sampling factors without a whole ratio")
        # samples beyond the image take no part in enlarging
        own = plane[: -(-header.height * c.down // highest), : -(-header.width * c.across // widest)]
        whole.append(_enlarged(own, highest // c.down, widest // c.across)[: header.height, : header.width])
    if len(whole) == 1:
        pixels = whole[0][:, :, None]
    elif header.transform == 0 or header.transform is None and [c.number for c in header.components] == list(b"RGB"):
        pixels = np.stack(whole[::-1], 2)
    else:
        y, blue, red = whole[0], whole[1] - 128, whole[2] - 128
        pixels = np.stack([y + 1.772 * blue, y - 0.344136 * blue - 0.714136 * red, y + 1.402 * red], 2)
    return _turned(np.clip(np.floor(pixels + 0.5), 0, 255).astype(np.uint8), header.orientation)


def _turned(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The image as an EXIF orientation says it is to be seen."""
    if orientation >= 5:
        pixels = pixels.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


# encoding


def quantiser(base: str, quality: int) -> np.ndarray:
    """A table for a quality of 1 to 100, in rows; 50 is the standard's own."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    table = np.array(base.split(), np.int64)
    return np.clip((table * scale + 50) // 100, 1, 255)


def _code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of Huffman codes of at most 16 bits, none of them all ones, for symbols that occur."""
    import heapq

    heap = [(int(n), s, [s]) for s, n in enumerate(counts) if n]
    # a symbol that never occurs takes the code of all ones
    heap.append((0, -1, [-1]))
    heapq.heapify(heap)
    lengths = {s: 0 for _, _, group in heap for s in group}
    while len(heap) > 1:
        (n, a, left), (m, b, right) = heapq.heappop(heap), heapq.heappop(heap)
        for s in left + right:
            lengths[s] += 1
        heapq.heappush(heap, (n + m, min(a, b), left + right))
    many = np.bincount(list(lengths.values()), minlength=17)
    for long in range(len(many) - 1, 16, -1):
        # two codes that are too long give their prefix to one of them; the other joins a shorter code
        while many[long]:
            short = max(k for k in range(1, long - 1) if many[k])
            many[long] -= 2
            many[long - 1] += 1
            many[short + 1] += 2
            many[short] -= 1
    order = sorted(lengths, key=lambda s: (lengths[s], s == -1, s))
    dealt = dict(zip(order, np.repeat(np.arange(len(many)), many).tolist(), strict=True))
    longest = max(dealt.values())
    if dealt[-1] != longest:  # the reserved code has to be among the longest
        other = next(s for s in order if dealt[s] == longest)
        dealt[other], dealt[-1] = dealt[-1], longest
    del dealt[-1]
    return dealt


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table as it is stored."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, values, sizes = 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    last = 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        values[s], sizes[s] = code, last
        code += 1
    counts = np.bincount(list(lengths.values()), minlength=17)[1:17]
    return values, sizes, bytes(counts.tolist()) + bytes(order)


def _events(blocks: np.ndarray, part: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, ...]:
    """The symbols of blocks (in coded order) as (component, is AC, symbol, bits, number of bits, interval)."""
    dc = blocks[:, 0].copy()
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        first = np.diff(interval[mine], prepend=-1) > 0
        before = np.concatenate([[0], blocks[mine[:-1], 0]])
        dc[mine] -= np.where(first, 0, before)
    block, place = np.nonzero(blocks[:, 1:])
    place = place + 1
    value = blocks[block, place]
    run = place - np.where(np.diff(block, prepend=-1) > 0, 0, np.concatenate([[0], place[:-1]])) - 1
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    zeros = run // 16
    many = np.arange(len(blocks))
    long = np.repeat(np.arange(len(block)), zeros)
    size = lambda v: np.where(v, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1, 0)
    sizes = [size(dc), np.zeros(len(long), np.int64), size(value), np.zeros(len(ends), np.int64)]
    owner = np.concatenate([many, block[long], block, ends])
    kind = np.concatenate([np.zeros(len(many), bool), np.ones(len(long) + len(block) + len(ends), bool)])
    symbol = np.concatenate([sizes[0], np.full(len(long), 0xF0), (run % 16) << 4 | sizes[2], np.zeros(len(ends), np.int64)])
    number = np.concatenate([dc, np.zeros(len(long), np.int64), value, np.zeros(len(ends), np.int64)])
    width = np.concatenate(sizes)
    bits = np.where(number < 0, number + (1 << width) - 1, number)
    within = np.concatenate([np.zeros(len(many)), place[long] - 0.5, place, np.full(len(ends), 64)])
    order = np.lexsort((within, owner))
    return part[owner][order], kind[order], symbol[order], bits[order], width[order], interval[owner][order]


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of given widths as bytes, filled up with ones, and with zeros stuffed after bytes of all ones."""
    at = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
    bits = np.repeat(values, widths) >> (np.repeat(widths, widths) - 1 - at) & 1
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)])
    return np.packbits(bits.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body


def encode_jpeg(array: np.ndarray, quality: int = 95, halve: bool = True, restart: int = 0) -> bytes:
    """A baseline file of a (height, width, 1 or 3) array; ``halve`` stores chroma at half size (4:2:0).

    ``restart`` units of blocks stand between restart markers, 0 for none.
    """
    h, w, channels = array.shape
    if channels not in (1, 3) or not 0 < h < 1 << 16 or not 0 < w < 1 << 16:
        raise JpegError("an image of this size or number of channels can't be written")
    pixels = array.astype(np.float64)
    if channels == 3:
        b, g, r = (pixels[:, :, k] for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    else:
        planes = [pixels[:, :, 0]]
    unit = 2 if halve and channels == 3 else 1
    rows, columns = -(-h // (8 * unit)), -(-w // (8 * unit))
    tables = [quantiser(LUMINANCE, quality), quantiser(CHROMINANCE, quality)]
    coded, kinds, places = [], [], []
    for k, plane in enumerate(planes):
        own = unit if k == 0 else 1
        if own < unit:
            even = np.pad(plane, ((0, h % 2), (0, w % 2)), mode="edge")
            plane = (even[0::2, 0::2] + even[1::2, 0::2] + even[0::2, 1::2] + even[1::2, 1::2]) / 4
        plane = np.pad(plane, ((0, rows * own * 8 - plane.shape[0]), (0, columns * own * 8 - plane.shape[1])), mode="edge") - 128
        grid = plane.reshape(rows, own, 8, columns, own, 8).transpose(0, 3, 1, 4, 2, 5)  # units in order, their blocks in order
        freq = COSINES @ grid.reshape(-1, 8, 8) @ COSINES.T
        table = tables[min(k, 1)]
        coded.append(np.rint(np.round(freq.reshape(-1, 64) / table, 6)).astype(np.int64)[:, ZIGZAG])
        kinds.append(np.full(len(coded[-1]), k))
        places.append(np.repeat(np.arange(rows * columns), own * own))
    place = np.concatenate(places)
    order = np.lexsort((np.concatenate(kinds), place))
    interval = place[order] // restart if restart else np.zeros(len(order), np.int64)
    part, is_ac, symbol, bits, width, interval = _events(np.concatenate(coded)[order], np.concatenate(kinds)[order], interval)
    value, size, stored = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), b""
    for chroma in range(min(2, channels)):
        for ac in (0, 1):
            mine = np.flatnonzero((np.minimum(part, 1) == chroma) & (is_ac == bool(ac)))
            codes, sizes, table = _codes(_code_lengths(np.bincount(symbol[mine], minlength=256)))
            value[mine], size[mine] = codes[symbol[mine]], sizes[symbol[mine]]
            stored += _segment(0xC4, bytes([ac << 4 | chroma]) + table)
    value, size = value << width | bits, size + width
    cuts = np.flatnonzero(np.diff(interval, prepend=0)) if restart else np.zeros(0, np.int64)
    runs = [_packed(v, s) for v, s in zip(np.split(value, cuts), np.split(size, cuts), strict=True)]
    body = runs[0] + b"".join(bytes([0xFF, 0xD0 + (k % 8)]) + run for k, run in enumerate(runs[1:]))
    frame = [(k + 1, unit << 4 | unit if k == 0 else 0x11, min(k, 1)) for k in range(channels)]
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for k, table in enumerate(tables[: min(2, channels)]):
        out += _segment(0xDB, bytes([k]) + bytes(table[ZIGZAG].tolist()))
    out += _segment(0xC0, b"\x08" + h.to_bytes(2) + w.to_bytes(2) + bytes([channels]) + bytes(x for c in frame for x in c)) + stored
    if restart:
        out += _segment(0xDD, restart.to_bytes(2))
    scan = bytes([channels]) + bytes(x for k in range(channels) for x in (k + 1, min(k, 1) * 0x11)) + b"\0\x3f\0"
    return out + _segment(0xDA, scan) + body + b"\xff\xd9"
