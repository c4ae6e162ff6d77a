"""Sinks: image files, videos, JSON lines and console reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.display import padded, two_places
from lumenframe.operators import detections, kernels
from lumenframe.sources.images import encode_pnm
from lumenframe.sources.jpeg import encode_jpeg
from lumenframe.sources.png import encode_png
from lumenframe.streaming.tracking import write_each_batch
from lumenframe.workspace import pieces


#: Encoders by file suffix.
ENCODERS = {".ppm": encode_pnm, ".png": encode_png, ".jpg": encode_jpeg}


def write_images(df: DataFrame, folder: str, name: str, encode: Callable | None = None, suffix: str = ".ppm") -> DataFrame:
    """Write each row's image as a file named by column ``name``; returns (name, path, bytes) when run.

    The suffix tells the format (.jpg, .png or .ppm) unless ``encode`` is given.

    Files are written by tasks through the file system of the folder's URI, and
    a retried task overwrites its own files with the same bytes.
    """
    encode = encode or ENCODERS[suffix]
    return _written(df.select(F.col(name).cast("string"), "image"), folder, suffix, lambda image: encode(kernels.to_array(image)))


def write_texts(df: DataFrame, folder: str, name: str, text: str, suffix: str = ".txt") -> DataFrame:
    """Write column ``text`` of each row as a file in UTF-8, named like ``write_images``'s; null texts are left out.

    For many small files: Spark's own writer spends tens of milliseconds on each.
    """
    return _written(df.select(F.col(name).cast("string"), text), folder, suffix, str.encode)


def _written(named: DataFrame, folder: str, suffix: str, encode: Callable) -> DataFrame:
    """Files of the rows (name, value), written by tasks: (name, path, bytes) when run."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in pieces(batches, 256, 4 << 20):
            rows = {"name": [], "path": [], "bytes": []}
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value is None:
                    continue
                data = encode(value)
                with system.open_output_stream(f"{root}/{key}{suffix}") as out:
                    out.write(data)
                rows["name"].append(key)
                rows["path"].append(f"{folder}/{key}{suffix}")
                rows["bytes"].append(len(data))
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("name", pa.string()), ("path", pa.string()), ("bytes", pa.int64())]))

    return named.mapInArrow(run, "name string, path string, bytes long")


def write_videos(frames: DataFrame, folder: str, encode: Callable) -> DataFrame:
    """Write one video per video_id in frame order; returns (video_id, path, frames) when run.

    ``encode(path, fps, frames)`` gets an iterator, so a task holds one frame at
    a time: rows are sorted by Spark within partitions of whole videos.
    """
    ordered = frames.repartition("video_id").sortWithinPartitions("video_id", "frame_idx")

    def run(batches):
        import itertools

        import pyarrow as pa

        rows = (r for batch in batches for r in batch.to_pylist())
        for video, group in itertools.groupby(rows, key=lambda r: r["video_id"]):
            first = next(group)
            count = 0

            def pictures(first=first, group=group):
                nonlocal count
                for r in itertools.chain([first], group):
                    count += 1
                    yield kernels.to_array(r["image"])

            path = f"{folder}/{video.rsplit('/', 1)[-1]}"
            encode(path, first["fps"], pictures())
            yield pa.RecordBatch.from_pydict({"video_id": [video], "path": [path], "frames": [count]})

    return ordered.select("video_id", "frame_idx", "fps", "image").mapInArrow(run, "video_id string, path string, frames long")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, as the rows stand."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def detection_lines(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Display lines of numbered vehicle detections, beside the columns to keep."""
    corners = F.concat(F.lit("("), F.array_join(F.col("bbox").cast("array<string>"), ", "), F.lit(")"))
    return df.select(*(keep or []), F.concat_ws(" ", F.concat(F.col("n").cast("string"), F.lit(".")), "class", two_places("confidence"), corners).alias("line"))


def frame_lines(df: DataFrame) -> DataFrame:
    """Display lines of frames with their number of detections."""
    return df.select(F.concat_ws(" ", F.lit("Frame"), padded(F.col("frame_idx") + 1), F.lit("|"), F.size("track_ids").cast("string")).alias("line"))


def report(rows: DataFrame, line: str, order: list[str], banner: str, none: str, totals: dict[str, Column]) -> DataFrame:
    """A console report as rows (section, the order's columns, part, line).

    The banner, the lines of ``rows`` in ``order`` or what stands for none, then a line for
    each total, a label and an aggregate over all rows, and a rule as long as the banner.
    """
    head = F.lit(f"===== {banner} =====")
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]
    one = rows.sparkSession.range(1)

    def section(df: DataFrame, number: int, part: Column, text: Column) -> DataFrame:
        return df.select(F.lit(number).alias("section"), *blank, part.cast("int").alias("part"), text.alias("line"))

    body = rows.select(F.lit(1).alias("section"), *order, F.lit(0).alias("part"), F.col(line).alias("line"))
    said = [F.concat(F.lit(f"{label}: "), value.cast("string")) for label, value in totals.items()]
    summed = rows.agg(F.array(*said).alias("said")).select(F.posexplode("said").alias("part", "line"))
    return (
        section(one, 0, F.lit(0), head)
        .unionAll(body)
        .unionAll(section(detections.note_if_empty(rows, none), 1, F.lit(0), F.col("line")))
        .unionAll(section(summed, 2, F.col("part"), F.col("line")))
        .unionAll(section(one, 3, F.lit(0), F.repeat(F.lit("="), F.length(head))))
    )


def print_report(reported: DataFrame, write: Callable[[str], None] = print) -> None:
    """Write a report's lines in order; the driver holds one partition of them at a time."""
    *order, _ = reported.columns
    for r in reported.orderBy(*order).select("line").toLocalIterator():
        write(r.line)


def console(stream: DataFrame, of: Callable[[DataFrame], DataFrame], checkpoint: str, write: Callable[[str], None] = print):
    """Write the report that ``of`` makes of each micro-batch; returns the running query."""
    return write_each_batch(stream, lambda batch, _: print_report(of(batch), write), checkpoint)
