"""Suppression of overlapping boxes, and the raw rows of detectors that need it.

Suppression is a fold over an image's boxes, best first: a box stays if it overlaps
none that stayed before it by more than a limit. It is one expression within the
row, so nothing is joined or shuffled; its work grows with boxes times boxes kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import boxes
from lumenframe.schema import BOX


def suppress(found: Column, most_iou: float, per_class: bool = True, most: int | None = None) -> Column:
    """The boxes of an array of BOX that no better box suppresses, best first; at most ``most``.

    The first of equally confident boxes goes first; boxes whose confidence is null
    or NaN go last. A null or NaN coordinate, or a box without area, overlaps nothing.
    Null boxes are dropped, and a null array stays null.
    """
    kind = f"array<{BOX.simpleString()}>"

    def ranked(box: Column, pos: Column) -> Column:
        unsure = box.getField("confidence").isNull() | F.isnan(box.getField("confidence"))
        return F.struct(unsure.alias("unsure"), F.when(unsure, 0.0).otherwise(-box.getField("confidence")).alias("rank"), pos.alias("pos"), box.alias("box"))

    def overlaps(kept: Column, box: Column) -> Column:
        overlap = boxes.iou(kept.getField("xyxy"), box.getField("xyxy"))
        same = kept.getField("class_id").eqNullSafe(box.getField("class_id")) if per_class else F.lit(True)
        return same & F.coalesce(~F.isnan(overlap) & (overlap > most_iou), F.lit(False))

    def fold(kept: Column, box: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlaps(k, box)), kept).otherwise(F.concat(kept, F.array(box)))

    # positions are compared before boxes, which makes the order total
    order = F.array_sort(F.transform(F.filter(found, lambda b: b.isNotNull()), ranked), _before)
    stayed = F.aggregate(F.transform(order, lambda r: r.getField("box")), F.array().cast(kind), lambda kept, box: fold(kept, box).cast(kind))
    return stayed if most is None else F.slice(stayed, 1, most)


def _before(a: Column, b: Column) -> Column:
    """Order of ranked boxes: sure ones first, then the more confident, then the earlier."""
    step = lambda name: F.when(a.getField(name) < b.getField(name), -1).when(a.getField(name) > b.getField(name), 1)
    return F.coalesce(step("unsure"), step("rank"), step("pos"), F.lit(0))


def suppress_results(df: DataFrame, most_iou: float, per_class: bool = True, most: int | None = None, results: str = "results") -> DataFrame:
    """``df`` with overlapping boxes suppressed within each of an image's results."""
    return df.withColumn(results, F.transform(results, lambda r: suppress(r, most_iou, per_class, most)))


def decode_raw(output: np.ndarray, scale: float, least: float) -> list[tuple]:
    """Boxes of a raw output of shape (4 + classes, anchors): centre and sides, then a score for each class.

    Every anchor gives its best class, the first of equals, if that scores at least
    ``least``; coordinates are divided by ``scale``. Order is that of the anchors.
    """
    sides, scores = output[:4].astype(float) / scale, output[4:]
    best = scores.argmax(0)
    score = scores[best, np.arange(scores.shape[1])].astype(float)
    corners = np.stack([sides[0] - sides[2] / 2, sides[1] - sides[3] / 2, sides[0] + sides[2] / 2, sides[1] + sides[3] / 2])
    return [(int(best[k]), float(score[k]), *map(float, corners[:, k])) for k in np.flatnonzero(score >= least)]
