"""Image files as rows; decoding is pluggable and runs in tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.schema import IMAGE
from lumenframe.sources.jpeg import decode_jpeg
from lumenframe.sources.png import SIGNATURE, decode_png
from lumenframe.workspace import pieces

Decode = Callable[[bytes], np.ndarray | None]


def decode_pnm(data: bytes) -> np.ndarray | None:
    """Binary PGM and PPM with 8 bits a sample, as BGR or gray; None if it isn't one."""
    import re

    head = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not head or int(head[4]) > 255:
        return None
    channels = 3 if head[1] == b"P6" else 1
    w, h = int(head[2]), int(head[3])
    body = data[head.end() : head.end() + w * h * channels]
    if len(body) < w * h * channels or not body:
        return None
    return np.frombuffer(body, np.uint8).reshape(h, w, channels)[:, :, ::-1]


def encode_pnm(array: np.ndarray) -> bytes:
    h, w, c = array.shape
    return f"P{6 if c == 3 else 5}\n{w} {h}\n255\n".encode() + np.ascontiguousarray(array[:, :, ::-1]).tobytes()


def decode_image(data: bytes) -> np.ndarray | None:
    """JPEG, PNG, PGM or PPM by the first bytes; None, or an error of the decoder's, if it can't be read."""
    if data.startswith(b"\xff\xd8"):
        return decode_jpeg(data)
    return decode_png(data) if data.startswith(SIGNATURE) else decode_pnm(data)


def read_images(spark: SparkSession, path: str, decode: Decode = decode_image, glob: str = "*") -> DataFrame:
    """Rows (path, image); the image is null if the file can't be decoded.

    Only the path and the content are read, and the content goes no further
    than the decoding stage.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("image", IMAGE)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        from lumenframe.operators.kernels import to_image

        for batch in pieces(batches, 64, 4 << 20):
            images = []
            for content in batch.column("content").to_pylist():
                try:
                    array = decode(content)
                except Exception:  # a decoder's own errors mean an unreadable file
                    array = None
                images.append(None if array is None else to_image(array))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(images, to_arrow_type(IMAGE))], ["path", "image"])

    return files.select("path", "content").mapInArrow(run, schema)


def readable(images: DataFrame) -> DataFrame:
    return images.where(F.col("image").isNotNull())


def unreadable_count(images: DataFrame) -> DataFrame:
    """One row with the numbers of images and of those that could not be decoded."""
    return images.agg(F.count("*").alias("images"), F.count_if(F.col("image").isNull()).alias("unreadable"))
