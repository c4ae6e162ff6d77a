"""Types of images, boxes, readings, frames and annotations, and the settings of the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

IMAGE = T.StructType(
    [
        T.StructField("height", T.IntegerType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("n_channels", T.IntegerType(), False),
        T.StructField("data", T.BinaryType(), False),
    ]
)
#: Raw model output: one box.
BOX = T.StructType(
    [
        T.StructField("class_id", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("xyxy", T.ArrayType(T.DoubleType())),
    ]
)
#: What OCR says about an image: parallel lists, possibly of unequal lengths.
OCR_DOC = T.StructType(
    [
        T.StructField("rec_texts", T.ArrayType(T.StringType())),
        T.StructField("rec_scores", T.ArrayType(T.DoubleType())),
    ]
)
READING = T.StructType(
    [
        T.StructField("text", T.StringType(), False),
        T.StructField("detection_confidence", T.DoubleType()),
        T.StructField("ocr_confidence", T.DoubleType(), False),
        T.StructField("bbox", T.ArrayType(T.IntegerType())),
    ]
)
FRAME = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("image", IMAGE),
    ]
)
_BOUNDS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
_ATTRIBUTES = T.StructType(
    [
        T.StructField(
            "attribute",
            T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])),
        )
    ]
)
VOC = T.StructType(
    [
        T.StructField("folder", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField(
            "source", T.StructType([T.StructField(c, T.StringType()) for c in ("database", "annotation", "image")])
        ),
        T.StructField(
            "size",
            T.StructType(
                [
                    T.StructField("width", T.IntegerType()),
                    T.StructField("height", T.IntegerType()),
                    T.StructField("depth", T.StringType()),
                ]
            ),
        ),
        T.StructField("segmented", T.IntegerType()),
        T.StructField(
            "object",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        *[T.StructField(c, T.IntegerType()) for c in ("truncated", "occluded", "difficult")],
                        T.StructField("bndbox", _BOUNDS),
                        T.StructField("attributes", _ATTRIBUTES),
                    ]
                )
            ),
        ),
    ]
)

#: The vehicle classes by the detector's class id.
VEHICLE_CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}


@dataclass(frozen=True)
class Settings:
    """Thresholds and factors of the plans; the defaults are fixed values, which results depend on."""

    min_confidence: float = 0.25
    largest_scale: float = 5.0
    longest_side: float = 3800.0
    fixed_scale: float = 3.0
    inspection_scale: float = 8.0
    margin_x: float = 0.15
    margin_y: float = 0.25
    clip_limit: float = 2.0
    tiles: int = 8
    stride: int = 10
    seek_frame: int = 180
    classes: dict[int, str] = field(default_factory=lambda: dict(VEHICLE_CLASSES))
