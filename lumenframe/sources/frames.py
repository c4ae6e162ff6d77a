"""Frames of videos, planned and decoded by tasks, with no other frame decoded than asked for.

Tasks open the files and read their headers, which makes a manifest; ranges of frames
are made from it, dealt out, and decoded. The driver opens no file, whatever their
number. A decoder has ``open(path) -> (fps, width, height, frame count)`` and
``read(path, start, stop, step)``, which yields arrays, or None for a damaged frame;
it travels to the tasks by value. Without one, .npy files are arrays of shape (frames,
height, width, channels) on a file system of the machine, and others AVI files of
JPEG frames on any file system.

Defined results: a file that can't be opened has no fps in the manifest and no
frames; a damaged frame has a null image; a file named twice is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators import kernels
from lumenframe.schema import FRAME
from lumenframe.sources import avi
from lumenframe.sources.jpeg import JpegError, decode_jpeg

#: Frames in one range.
FRAMES_PER_TASK = 256
MANIFEST = T.StructType(
    [T.StructField("video_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("fps", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("width", "height")]
    + [T.StructField("frames", T.LongType())]
)


def open_store(uri: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class NpyVideo:
    """Frames of an uncompressed .npy video, mapped rather than loaded."""

    fps = 25.0

    def _mapped(self, path: str) -> np.ndarray:
        return np.load(path.removeprefix("file:").replace("///", "/"), mmap_mode="r")

    def open(self, path: str) -> tuple[float, int, int, int]:
        frames = self._mapped(path)
        return self.fps, frames.shape[2], frames.shape[1], frames.shape[0]

    def read(self, path: str, start: int, stop: int, step: int) -> Iterator[np.ndarray | None]:
        yield from self._mapped(path)[start:stop:step]


class AviVideo:
    """JPEG frames of an AVI file, read through its index."""

    def open(self, path: str) -> tuple[float, int, int, int]:
        system, inner = open_store(path)
        with system.open_input_file(inner) as file:
            video = avi.open_video(file)
        return video.fps, video.width, video.height, video.frames

    def read(self, path: str, start: int, stop: int, step: int) -> Iterator[np.ndarray | None]:
        system, inner = open_store(path)
        with system.open_input_file(inner) as file:
            for _, coded in avi.read_frames(file, avi.open_video(file), start, stop, step):
                try:
                    yield decode_jpeg(coded)
                except JpegError:
                    yield None


def decoder_of(path: str, decoder=None):
    """The decoder given, or the one that a file's suffix tells."""
    return decoder or (NpyVideo() if path.endswith(".npy") else AviVideo())


def video_manifest(files: DataFrame, decoder=None) -> DataFrame:
    """Headers of video files, read by tasks; ``files`` has video_id and path."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(MANIFEST)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_headed(r, decoder) for r in batch.to_pylist()], kind)

    return files.select(F.col("video_id").cast("string"), "path").mapInArrow(run, MANIFEST)


def _headed(row: dict, decoder) -> dict:
    try:
        found = decoder_of(row["path"], decoder).open(row["path"])
    except (OSError, ValueError):  # such as a file that isn't there, or none of this kind
        found = (None, None, None, None)
    return row | dict(zip(("fps", "width", "height", "frames"), found, strict=True))


def ranges(manifest: DataFrame, stride: int = 1, start: int = 0, stop: int | None = None, per_task: int = FRAMES_PER_TASK) -> DataFrame:
    """Rows (video_id, path, fps, first, last): ranges of ``per_task`` wanted frames; every ``stride``-th counted from 1."""
    first = start + -(start + 1) % stride
    end = F.col("frames") if stop is None else F.least("frames", F.lit(stop).cast("long"))
    firsts = F.when(end > first, F.sequence(F.lit(first).cast("long"), end - 1, F.lit(per_task * stride).cast("long")))
    dealt = manifest.where("frames > 0").select("video_id", "path", "fps", end.alias("end"), F.explode(firsts).alias("first"))
    return dealt.select("video_id", "path", "fps", "first", F.least("end", F.col("first") + per_task * stride).alias("last"))


def decode_ranges(dealt: DataFrame, stride: int = 1, decoder=None) -> DataFrame:
    """Frames of ranges, each range dealt out by itself and held one frame at a time."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(FRAME)
        for batch in batches:
            for r in batch.to_pylist():
                for k, frame in decoded(r, stride, decoder):
                    image = None if frame is None else kernels.to_image(frame)
                    yield pa.RecordBatch.from_pylist([{"video_id": r["video_id"], "frame_idx": k, "fps": r["fps"], "image": image}], kind)

    return dealt.repartition("path", "first").mapInArrow(run, FRAME)


def decoded(row: dict, stride: int, decoder=None) -> Iterator[tuple[int, np.ndarray | None]]:
    """Numbers and pixels of one range's frames."""
    found = decoder_of(row["path"], decoder).read(row["path"], row["first"], row["last"], stride)
    for n, frame in enumerate(found):
        yield row["first"] + n * stride, frame


def read_videos(files: DataFrame, decoder=None, stride: int = 1, start: int = 0, stop: int | None = None) -> DataFrame:
    """Frames of the files in a table (video_id, path), numbered from 0, with fps and image.

    Every ``stride``-th frame, counted from 1, of those from ``start`` up to before
    ``stop`` (the end if None); no other frame is decoded.
    """
    return decode_ranges(ranges(video_manifest(files, decoder), stride, start, stop), stride, decoder)


def read_frames(spark: SparkSession, paths: list[str], decoder=None, stride: int = 1, start: int = 0, stop: int | None = None) -> DataFrame:
    """``read_videos`` of a list of paths, each its video's id."""
    files = spark.createDataFrame([(p, p) for p in paths], "video_id string, path string")
    return read_videos(files, decoder, stride, start, stop)


def video_metadata(frames: DataFrame) -> DataFrame:
    """fps, width and height of each video, from its first frame; read frames with ``stop=1`` to decode no other."""
    return frames.where(F.col("frame_idx") == 0).select(
        "video_id", "fps", F.col("image.width").alias("width"), F.col("image.height").alias("height")
    )
