"""AVI files of JPEG frames: chunks of coded frames between headers and an index.

Everything works on open files with ``read``, ``seek`` and ``write``, so any file
system will do. A file holds one video stream and the index of its first list,
thus up to four gigabytes; longer videos are an error when written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

#: Fixed values of the format: the stream's chunk name, its codec, and the flag of a frame that stands alone.
CHUNK, CODEC, KEY_FRAME, HAS_INDEX = b"00dc", b"MJPG", 0x10, 0x10
#: Bytes copied at a time, and the largest file.
PIECE, LARGEST = 1 << 20, (1 << 32) - 1
#: Frames a second are stored as a fraction of this denominator.
RATE = 100_000


class AviError(ValueError):
    """The file is damaged or of a kind that isn't read."""


@dataclass(frozen=True)
class Video:
    """What the headers of a file say, and where its index stands."""

    fps: float
    width: int
    height: int
    frames: int
    movie: int
    index: int


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def frame_chunk(coded: bytes) -> bytes:
    """A coded frame as it stands among the frames."""
    return _chunk(CHUNK, coded)


def chunk_size(size: int) -> int:
    """Bytes that a frame of ``size`` bytes takes."""
    return 8 + size + size % 2


def header(fps: float, width: int, height: int, sizes: list[int]) -> bytes:
    """Everything before the frames, whose coded sizes are given."""
    many, largest = len(sizes), max(sizes, default=0)
    movie = 4 + sum(map(chunk_size, sizes))
    if movie + 16 * many + 512 > LARGEST:  # the headers take some three hundred bytes
        raise AviError("the video is too long for one file")
    main = struct.pack("<14I", round(1e6 / fps), min(LARGEST, largest * max(1, round(fps))), 0, HAS_INDEX, many, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vids" + CODEC + struct.pack("<IHHI5IiI4H", 0, 0, 0, 0, RATE, round(fps * RATE), 0, many, largest, -1, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, CODEC, width * height * 3, 0, 0, 0, 0)
    headers = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    size = 4 + len(headers) + 8 + movie + 8 + 16 * many
    return b"RIFF" + struct.pack("<I", size) + b"AVI " + headers + b"LIST" + struct.pack("<I", movie) + b"movi"


def index(sizes: list[int]) -> bytes:
    """What stands after the frames: place and size of each."""
    out, at = [], 4
    for size in sizes:
        out.append(struct.pack("<4s3I", CHUNK, KEY_FRAME, at, size))
        at += chunk_size(size)
    return _chunk(b"idx1", b"".join(out))


def stitch(out, fps: float, width: int, height: int, sizes: list[int], segments: Iterable) -> None:
    """Write a whole file to ``out`` from open segments of frame chunks, in order."""
    out.write(header(fps, width, height, sizes))
    for segment in segments:
        while part := segment.read(PIECE):
            out.write(part)
    out.write(index(sizes))


def open_video(file) -> Video:
    """Read the headers and find the index; frames are not touched."""
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"AVI ":
        raise AviError("not an AVI file")
    at, fps, width, height, many, movie = 12, 0.0, 0, 0, 0, 0
    while True:
        file.seek(at)
        start = file.read(12)
        if len(start) < 8:
            raise AviError("the index is missing")
        kind, size = start[:4], struct.unpack("<I", start[4:8])[0]
        if kind == b"LIST" and start[8:12] == b"hdrl":
            fps, width, height = _headers(file.read(size - 4))
        elif kind == b"LIST" and start[8:12] == b"movi":
            movie = at + 8
        elif kind == b"idx1":
            many = size // 16
            if not movie or not fps:
                raise AviError("headers or frames are missing")
            return Video(fps, width, height, many, movie, at + 8)
        at += 8 + size + size % 2


def _headers(body: bytes) -> tuple[float, int, int]:
    stream = body.find(b"strh")
    if stream < 0 or body[stream + 8 : stream + 12] != b"vids" or body[stream + 12 : stream + 16] != CODEC or len(body) < stream + 36:
        raise AviError("not a stream of JPEG frames")
    scale, rate = struct.unpack("<II", body[stream + 28 : stream + 36])
    main = body.find(b"avih")
    if main < 0 or not scale or not rate:
        raise AviError("a header is missing")
    width, height = struct.unpack("<II", body[main + 40 : main + 48])
    return rate / scale, width, height


def read_frames(file, video: Video, start: int, stop: int, step: int = 1) -> Iterator[tuple[int, bytes]]:
    """Number and coded bytes of every ``step``-th frame of a range, through its part of the index."""
    file.seek(video.index + 16 * start)
    entries = file.read(16 * (min(stop, video.frames) - start))
    for k in range(0, len(entries) // 16, step):
        kind, _, at, size = struct.unpack("<4s3I", entries[16 * k : 16 * k + 16])
        file.seek(video.movie + at + 8)
        coded = file.read(size)
        if kind[2:] != CHUNK[2:] or len(coded) != size:
            raise AviError("a frame is cut off")
        yield start + k, coded
