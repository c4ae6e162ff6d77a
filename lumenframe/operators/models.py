"""Model stages: detectors and OCR run on Arrow batches of images inside tasks.

A model is described by a small spec with ``load()``; it is loaded once in a
task, when the first image comes. Filters don't cross these stages, so frames
are sampled and columns are cut before them, and class or confidence limits are
passed in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators import kernels, lettering
from lumenframe.operators.suppression import decode_raw
from lumenframe.schema import BOX, IMAGE, OCR_DOC, Settings
from lumenframe.workspace import pieces

#: Images that a model which takes batches is given at once.
BATCH = 16
#: Rows, and about the bytes of them, that a stage holds as Python objects at once.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20


class Detector(Protocol):
    """Gives for each image a list of results, each a list of boxes (class_id, confidence, x1, y1, x2, y2)."""

    def predict(self, images: list[np.ndarray]) -> list[list[list[tuple]]]: ...


class Ocr(Protocol):
    """Gives for each image a list of documents {'rec_texts': [...], 'rec_scores': [...]}."""

    def predict(self, images: list[np.ndarray]) -> list[list[dict]]: ...


@dataclass(frozen=True)
class ModelSpec:
    """How to load a model: a function and its arguments, such as a path to weights."""

    factory: Callable
    arguments: tuple = ()
    options: dict = field(default_factory=dict)

    def load(self):
        return self.factory(*self.arguments, **self.options)


class ScriptedDetector:
    """Returns prepared boxes by the value of an image's first pixel; for tests and demonstrations."""

    def __init__(self, script: dict[int, list[list[tuple]]]):
        self.script = script

    def predict(self, images):
        return [self.script.get(int(i.flat[0]) if i.size else -1, []) for i in images]


class ScriptedOcr:
    """Returns prepared documents by the value of an image's central pixel."""

    def __init__(self, script: dict[int, list[dict]]):
        self.script = script

    def predict(self, images):
        return [self.script.get(int(i[i.shape[0] // 2, i.shape[1] // 2, 0]), []) for i in images]


class OnnxDetector:
    """A detector in an ONNX file.

    ``layout`` "rows": output rows are (x1, y1, x2, y2, confidence, class), already
    suppressed. "raw": (4 + classes, anchors), as such detectors give without it;
    apply ``suppression.suppress_results`` to what comes out. Images go in together
    if the model takes batches of any size.
    """

    def __init__(self, path: str, side: int = 640, layout: str = "rows", least: float = 0.0):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        given = self.session.get_inputs()[0]
        self.name, self.side, self.layout, self.least = given.name, side, layout, least
        self.batched = not isinstance(given.shape[0], int)

    def _canvas(self, image: np.ndarray) -> tuple[np.ndarray, float]:
        """The image in the upper left corner of a square, channels first, and its scale."""
        scale = self.side / max(image.shape[:2])
        h, w = (max(1, round(v * scale)) for v in image.shape[:2])
        canvas = np.full((self.side, self.side, 3), 114, np.uint8)
        canvas[:h, :w] = kernels.resize(image, w, h)
        return canvas[:, :, ::-1].transpose(2, 0, 1).astype(np.float32) / 255, scale

    def predict(self, images):
        out = []
        step = BATCH if self.batched else 1
        for at in range(0, len(images), step):
            canvases, scales = zip(*map(self._canvas, images[at : at + step]), strict=True)
            found = np.asarray(self.session.run(None, {self.name: np.stack(canvases)})[0])
            out += [[self._boxes(one, scale)] for one, scale in zip(found.reshape(len(scales), *found.shape[-2:]), scales, strict=True)]
        return out

    def _boxes(self, found: np.ndarray, scale: float) -> list[tuple]:
        if self.layout == "raw":
            return decode_raw(found, scale, self.least)
        return [(int(r[5]), float(r[4]), *(float(v) / scale for v in r[:4])) for r in found if r[4] >= self.least]


def _mapped(df: DataFrame, image: str, name: str, kind: T.DataType, run: Callable[[], Callable[[list], list]], drop: bool = False) -> DataFrame:
    """``df`` with a column that ``run()`` computes from the images of a batch; null images give null.

    ``drop`` leaves the images out. A column of the new one's name is an error, not overwritten.
    """
    if name in df.columns and not (drop and name == image):
        raise ValueError(f"the input has a column {name!r}, which this stage would overwrite")
    schema = T.StructType([f for f in df.schema.fields if not (drop and f.name == image)] + [T.StructField(name, kind)])

    def stage(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        predict = None
        for batch in pieces(batches, PIECE_ROWS, PIECE_BYTES):
            predict = predict or run()
            images = batch.column(image).to_pylist()
            have = [k for k, i in enumerate(images) if i is not None]
            found = [None] * len(images)
            for k, value in zip(have, predict([images[k] for k in have]) if have else [], strict=True):
                found[k] = value
            columns = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, to_arrow_type(kind))], [f.name for f in schema.fields])

    return df.mapInArrow(stage, schema)


RESULTS = T.ArrayType(T.ArrayType(BOX))
DOCS = T.ArrayType(OCR_DOC)


def detect(df: DataFrame, model: ModelSpec, classes: list[int] | None = None, least: float | None = None, image: str = "image") -> DataFrame:
    """``df`` with ``results``: arrays of boxes per result; limits are applied inside the stage."""

    def run():
        detector = model.load()

        def kept(box: tuple) -> bool:
            return (classes is None or box[0] in classes) and (least is None or not box[1] < least)

        def predict(images):
            found = detector.predict([kernels.to_array(i) for i in images])
            return [
                [[{"class_id": b[0], "confidence": b[1], "xyxy": [float(v) for v in b[2:6]]} for b in r if kept(b)] for r in results]
                for results in found
            ]

        return predict

    return _mapped(df, image, "results", RESULTS, run)


def read_text(df: DataFrame, model: ModelSpec, image: str = "image") -> DataFrame:
    """``df`` with ``docs``: the OCR documents of each image as they come."""

    def run():
        ocr = model.load()

        def predict(images):
            return [[_document(d) for d in docs] for docs in ocr.predict([kernels.to_array(i) for i in images])]

        return predict

    return _mapped(df, image, "docs", DOCS, run)


def _document(doc) -> dict:
    """A document from a dict, or from a function or method that returns it; absent lists are empty."""
    doc = doc() if callable(doc) else doc
    return {"rec_texts": list(doc.get("rec_texts") or []), "rec_scores": list(doc.get("rec_scores") or [])}


#: A kept box with its clipped corners and the pixels within them.
CROP = T.StructType([*BOX.fields, T.StructField("pos", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("crop", IMAGE)])


def detect_crops(df: DataFrame, model: ModelSpec, least: float | None = None, name: str = "crops", image: str = "image") -> DataFrame:
    """``df`` without its image, with the boxes that hold a pixel and their crops, in one stage.

    Images end here: what goes on grows with the crops, not with images times boxes.
    ``pos`` is a box's place among those that are confident enough. Boxes with a
    coordinate that is NaN or infinite hold no pixel.
    """

    def run():
        detector = model.load()

        def cut(array: np.ndarray, results: list) -> list[dict]:
            h, w = array.shape[:2]
            out = []
            confident = [b for r in results for b in r if least is None or not b[1] < least]
            for pos, b in enumerate(confident):
                if not all(map(math.isfinite, b[2:6])):
                    continue
                x1, y1, x2, y2 = (min(max(int(v), 0), most) for v, most in zip(b[2:6], (w, h, w, h), strict=True))
                if x2 > x1 and y2 > y1:
                    crop = kernels.to_image(array[y1:y2, x1:x2])
                    out.append({"class_id": b[0], "confidence": b[1], "xyxy": [float(v) for v in b[2:6]], "pos": pos, "bbox": [x1, y1, x2, y2], "crop": crop})
            return out

        def predict(images):
            arrays = [kernels.to_array(i) for i in images]
            return [cut(a, r) for a, r in zip(arrays, detector.predict(arrays), strict=True)]

        return predict

    return _mapped(df, image, name, T.ArrayType(CROP), run, drop=True)


def read_plates(df: DataFrame, model: ModelSpec, settings: Settings, variable_scale: bool = True, crop: str = "crop") -> DataFrame:
    """``df`` with ``docs`` instead of the crop of each row: enhance it and read it, fused in one stage."""

    def run():
        ocr = model.load()

        def enhanced(item: dict) -> np.ndarray:
            array = kernels.to_array(item)
            h, w = array.shape[:2]
            scale = min(settings.largest_scale, settings.longest_side / max(h, w)) if variable_scale else settings.fixed_scale
            size = (int(w * scale), int(h * scale)) if scale > 1 else (w, h)
            return kernels.enhance(array, *size, settings.clip_limit, settings.tiles)

        def predict(items):
            return [[_document(d) for d in docs] for docs in ocr.predict([enhanced(i) for i in items])]

        return predict

    return _mapped(df, crop, "docs", DOCS, run, drop=True)


def _packed(df: DataFrame, *columns) -> tuple[DataFrame, str]:
    """``df`` with columns in one struct, under a name that the input doesn't have."""
    name = "packed"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, F.struct(*columns)), name


def crops(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """``df`` with ``image`` cut to ``bbox`` and enlarged by ``scale``."""

    def run():
        def cut(items):
            return [kernels.to_image(_enlarged(kernels.crop(kernels.to_array(i["image"]), i["bbox"]), scale)) for i in items]

        return cut

    packed, name = _packed(df, "image", "bbox")
    return _mapped(packed.drop("image"), name, "image", IMAGE, run, drop=True)


def _enlarged(array: np.ndarray, scale: float) -> np.ndarray:
    return array if scale == 1.0 else kernels.resize(array, round(array.shape[1] * scale), round(array.shape[0] * scale))


def best_crops(df: DataFrame, model: ModelSpec, box_of: Callable[[list[int], int, int], list[int]], scale: float = 1.0, name: str = "best", image: str = "image") -> DataFrame:
    """``df`` without its image, with the crop of its most confident box, null if there is none; one stage.

    Confidences of 0, NaN and less never win, the first of equals does. ``box_of`` gives the
    box to cut from its whole corners and the image's width and height; it is clipped.
    """
    kind = T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("crop", IMAGE)])

    def run():
        detector = model.load()

        def best(array: np.ndarray, results: list) -> dict | None:
            h, w = array.shape[:2]
            won, confidence = None, 0.0
            for b in (b for r in results for b in r):
                if b[1] > confidence:
                    won, confidence = b, b[1]
            if won is None or not all(map(math.isfinite, won[2:6])):
                return None
            x1, y1, x2, y2 = (min(max(v, 0), most) for v, most in zip(box_of([int(v) for v in won[2:6]], w, h), (w, h, w, h), strict=True))
            if x2 <= x1 or y2 <= y1:
                return None
            return {"confidence": confidence, "bbox": [x1, y1, x2, y2], "crop": kernels.to_image(_enlarged(array[y1:y2, x1:x2], scale))}

        def predict(images):
            arrays = [kernels.to_array(i) for i in images]
            return [best(a, r) for a, r in zip(arrays, detector.predict(arrays), strict=True)]

        return predict

    return _mapped(df, image, name, kind, run, drop=True)


def annotate(df: DataFrame, boxes: str = "boxes", draw: Callable | None = None, labels: str | None = None) -> DataFrame:
    """``df`` with the boxes of each row drawn on its image, and their texts if ``labels`` names a column of them."""

    def run():
        def plot(items):
            out = []
            for item in items:
                array = kernels.to_array(item["image"])
                texts = item["labels"] or []
                for k, box in enumerate(item["boxes"] or []):
                    array = (draw or kernels.draw_box)(array, box)
                    if k < len(texts) and texts[k]:
                        array = lettering.draw_label(array, box, texts[k])
                out.append(kernels.to_image(array))
            return out

        return plot

    written = F.col(labels) if labels else F.lit(None).cast("array<string>")
    packed, name = _packed(df, "image", F.col(boxes).alias("boxes"), written.alias("labels"))
    return _mapped(packed.drop("image"), name, "image", IMAGE, run, drop=True)
