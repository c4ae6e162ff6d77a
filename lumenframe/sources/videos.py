"""Videos written as AVI files of JPEG frames by many tasks; ``frames`` reads them.

Tasks encode ranges of a video's frames into segments, each attempt under
a name of its own; then a task for each video stitches the segments of successful
attempts between header and index by copying bytes, without decoding.

Defined results: null images are left out, and a video without others isn't written;
frames of a size or number of channels other than the first are an error; equal
frame numbers are kept in no particular order; gaps in the numbers are closed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators import kernels
from lumenframe.sources import avi
from lumenframe.sources.frames import open_store
from lumenframe.sources.jpeg import encode_jpeg
from lumenframe.workspace import pieces

#: Frames that a task encodes at a time.
FRAMES_PER_TASK = 256
SEGMENT = T.StructType(
    [T.StructField("video_id", T.StringType()), T.StructField("part", T.LongType()), T.StructField("path", T.StringType()), T.StructField("fps", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("width", "height", "n_channels")]
    + [T.StructField("sizes", T.ArrayType(T.IntegerType()))]
)


def write_segments(frames: DataFrame, folder: str, quality: int = 95, per_task: int = FRAMES_PER_TASK) -> DataFrame:
    """Encode ranges of frame numbers into files below ``folder``; one row a segment, with its frames' sizes."""
    part = F.floor(F.col("frame_idx") / per_task).alias("part")
    dealt = frames.where(F.col("image").isNotNull()).select("video_id", part, "frame_idx", "fps", "image")
    dealt = dealt.repartition("video_id", "part").sortWithinPartitions("video_id", "part", "frame_idx")

    def run(batches):
        import itertools

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        system, root = open_store(folder)
        system.create_dir(root, recursive=True)
        rows = (r for batch in pieces(batches, FRAMES_PER_TASK, 4 << 20) for r in batch.to_pylist())
        for (video, part), group in itertools.groupby(rows, key=lambda r: (r["video_id"], r["part"])):
            name, sizes, shape = f"{uuid.uuid4().hex}.part", [], None
            with system.open_output_stream(f"{root}/{name}") as out:
                for r in group:
                    image = kernels.to_array(r["image"])
                    shape, fps = shape or image.shape, r["fps"]
                    if image.shape != shape:
                        raise ValueError(f"frames of video {video} have different sizes")
                    coded = encode_jpeg(image, quality)
                    out.write(avi.frame_chunk(coded))
                    sizes.append(len(coded))
            row = {"video_id": video, "part": part, "path": f"{folder}/{name}", "fps": fps, "sizes": sizes}
            row |= dict(zip(("height", "width", "n_channels"), shape, strict=True))
            yield pa.RecordBatch.from_pylist([row], to_arrow_schema(SEGMENT))

    return dealt.mapInArrow(run, SEGMENT)


def stitch_segments(segments: DataFrame, folder: str) -> DataFrame:
    """One file for each video below ``folder``; returns (video_id, path, frames) when run. ``segments`` must be written first."""
    ordered = segments.repartition("video_id").sortWithinPartitions("video_id", "part")

    def run(batches):
        import contextlib
        import hashlib
        import itertools
        import re

        import pyarrow as pa

        system, root = open_store(folder)
        system.create_dir(root, recursive=True)
        rows = (r for batch in batches for r in batch.to_pylist())
        for video, group in itertools.groupby(rows, key=lambda r: r["video_id"]):
            parts = list(group)  # names and sizes, a few bytes a frame
            first, sizes = parts[0], [s for p in parts for s in p["sizes"]]
            if any(p[c] != first[c] for p in parts for c in ("width", "height", "n_channels")):
                raise ValueError(f"frames of video {video} have different sizes")
            # a name that tells the video, and a hash where other characters had to go
            plain = re.sub(r"[^\w.-]", "_", (video or "").rsplit("/", 1)[-1])
            name = f"{plain}.avi" if plain == video else f"{plain}-{hashlib.sha256(repr(video).encode()).hexdigest()[:12]}.avi"

            def opened(parts=parts):
                for p in parts:
                    source, path = open_store(p["path"])
                    with contextlib.closing(source.open_input_stream(path)) as segment:
                        yield segment

            with system.open_output_stream(f"{root}/{name}") as out:
                avi.stitch(out, first["fps"] or 25.0, first["width"], first["height"], sizes, opened())
            yield pa.RecordBatch.from_pydict({"video_id": [video], "path": [f"{folder}/{name}"], "frames": [len(sizes)]})

    return ordered.mapInArrow(run, "video_id string, path string, frames long")


def list_videos(spark: SparkSession, folder: str, glob: str = "*.avi") -> DataFrame:
    """video_id (the path) and path of the files in a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("video_id"), "path")


def write_videos(frames: DataFrame, folder: str, quality: int = 95) -> DataFrame:
    """Write one AVI file for each video_id; returns (video_id, path, frames), all written when this returns.

    Segments and the table of them stand in ``folder`` too, under names that begin
    with an underscore; they can go when the files are there.
    """
    spark, inner = frames.sparkSession, f"{folder}/_{uuid.uuid4().hex}"
    write_segments(frames, f"{inner}/segments", quality).write.parquet(f"{inner}/table")
    stitch_segments(spark.read.schema(SEGMENT).parquet(f"{inner}/table"), folder).write.parquet(f"{inner}/videos")
    return spark.read.schema("video_id string, path string, frames long").parquet(f"{inner}/videos")

