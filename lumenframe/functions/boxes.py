"""Box geometry and box filters as column expressions; they stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.schema import Settings


def to_int_box(xyxy: Column) -> Column:
    """Coordinates truncated toward zero."""
    return F.transform(xyxy, lambda v: v.cast("int"))


def to_ints(values: Column) -> Column:
    """Numbers of a model, such as track ids, as whole numbers, truncated toward zero; a null array stays null."""
    return F.transform(values, lambda v: v.cast("int"))


def corner(box: Column, k: int) -> Column:
    """Coordinate ``k`` (x1, y1, x2, y2); null if the box is shorter."""
    return F.get(box, F.lit(k))


def first_item(items: Column) -> Column:
    """The first element; an error if there is none, under ANSI rules."""
    return items[0]


def class_label(class_id: Column, classes: dict[int, str]) -> Column:
    """The name of a class, null for others."""
    pairs = [F.lit(x) for kv in classes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), class_id)


def class_ids(classes: dict[int, str]) -> Column:
    """The class ids as an array, in the order of the mapping."""
    return F.map_keys(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]))


def is_class(class_id: Column, classes: dict[int, str]) -> Column:
    return class_id.isin(list(classes))


def confident(confidence: Column, least: float) -> Column:
    """Keeps the limit itself, and NaN; null confidences are not kept."""
    return ~(confidence < F.lit(least))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """The box within the image; negative corners become 0."""
    limit = lambda k, most: F.least(F.greatest(corner(box, k), F.lit(0)), most)
    return F.array(limit(0, width), limit(1, height), limit(2, width), limit(3, height))


def is_nonempty(box: Column) -> Column:
    """Whether a clipped box holds a pixel."""
    return (corner(box, 2) > corner(box, 0)) & (corner(box, 3) > corner(box, 1))


def expand_box(box: Column, width: Column, height: Column, settings: Settings) -> Column:
    """The box with margins in proportion to its own sides, within the frame."""
    dx = ((corner(box, 2) - corner(box, 0)) * F.lit(settings.margin_x)).cast("int")
    dy = ((corner(box, 3) - corner(box, 1)) * F.lit(settings.margin_y)).cast("int")
    return F.array(
        F.greatest(F.lit(0), corner(box, 0) - dx),
        F.greatest(F.lit(0), corner(box, 1) - dy),
        F.least(width, corner(box, 2) + dx),
        F.least(height, corner(box, 3) + dy),
    )


def resize_scale(width: Column, height: Column, settings: Settings) -> Column:
    """The factor that brings the longest side to its limit, at most the largest scale."""
    return F.least(F.lit(settings.largest_scale), F.lit(settings.longest_side) / F.greatest(width, height))


def resized_side(side: Column, scale: Column) -> Column:
    """The side after enlarging; a scale of one or less changes nothing."""
    return F.when(scale > 1, (side * scale).cast("int")).otherwise(side.cast("int"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 if neither has area."""
    side = lambda lo, hi: F.greatest(
        F.lit(0.0), F.least(corner(a, hi), corner(b, hi)).cast("double") - F.greatest(corner(a, lo), corner(b, lo))
    )
    area = lambda x: (corner(x, 2) - corner(x, 0)).cast("double") * (corner(x, 3) - corner(x, 1))
    common = side(0, 2) * side(1, 3)
    both = area(a) + area(b) - common
    return F.when(both > 0, common / both).otherwise(0.0)
