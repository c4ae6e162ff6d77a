"""Relational operators over detections: flattening, ranking, numbering, totals and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenframe.functions import boxes
from lumenframe.schema import Settings
from lumenframe.workspace import scratch


def flatten_results(df: DataFrame, results: str = "results") -> DataFrame:
    """Nested results (an array of arrays of boxes) as one row per box with its position ``pos``."""
    keep = [c for c in df.columns if c not in (results, "pos", "class_id", "confidence", "xyxy")]
    return df.select(*keep, F.posexplode(F.flatten(results)).alias("pos", "box")).select(*keep, "pos", "box.*")


def keep_classes(df: DataFrame, settings: Settings) -> DataFrame:
    """Boxes of the known classes with their label; no other threshold."""
    return df.where(boxes.is_class(F.col("class_id"), settings.classes)).withColumn(
        "class", boxes.class_label(F.col("class_id"), settings.classes)
    )


def label_by_join(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Inner lookup join with a dimension table; Spark broadcasts it by its own size check."""
    return df.join(dimension, key)


def keep_crops(df: DataFrame, settings: Settings, least: float | None = None) -> DataFrame:
    """Confident boxes cast to ints and clipped to their image, without those that hold no pixel."""
    least = settings.min_confidence if least is None else least
    return (
        df.where(boxes.confident(F.col("confidence"), least))
        .withColumn("bbox", boxes.clip_box(boxes.to_int_box(F.col("xyxy")), F.col("width"), F.col("height")))
        .where(boxes.is_nonempty(F.col("bbox")))
    )


def best_per_group(df: DataFrame, keys: list[str], score: str, order: list[str | Column]) -> DataFrame:
    """The row of each group with the highest score above 0; the first in ``order`` among equals.

    Groups without such a row give none; NaN never wins. The rank limit is
    applied before the shuffle as well as after it, so a hot group is cut early.
    """
    rank, name = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), *order)), unused(df.columns, "rank")
    return df.where((F.col(score) > 0) & ~F.isnan(score)).withColumn(name, rank).where(F.col(name) == 1).drop(name)


def number_rows(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """1-based numbers that restart with each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def number_split(df: DataFrame, keys: list[str], order: list[str], name: str = "n", slices: int = 64) -> DataFrame:
    """``number_rows`` where one key may hold most rows: a key's rows spread over many tasks.

    Rows are cut into about ``slices`` ranges of (keys, order) for all keys together and
    written with their range, in the shared folder, since sampled ranges wouldn't be the
    same twice. Each range is numbered by itself; what stands before a key in earlier
    ranges is joined back and added: a row for each key and range.
    ``order`` must be names of columns; rows that are equal in all of them are numbered
    in any order, and are in one range.
    """
    part, before, rank = (unused(df.columns, c) for c in ("part", "before", "rank"))
    path = scratch(df.sparkSession, "numbered")
    df.repartitionByRange(slices, *keys, *order).withColumn(part, F.spark_partition_id()).write.parquet(path)
    placed = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField(part, T.IntegerType())])).parquet(path)
    counted = placed.groupBy(*keys, part).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    within = Window.partitionBy(part, *keys).orderBy(*order)
    ranked = placed.withColumn(rank, F.row_number().over(within)).alias("l")
    same = F.col(f"l.{part}") == F.col(f"r.{part}")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = ranked.join(counted.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{rank}") + F.col(f"r.{before}")).cast("long").alias(name))


def unused(columns: list[str], name: str) -> str:
    """``name``, or the first longer one that no column has."""
    while name in columns:
        name += "_"
    return name


def stride(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th frame counted from 1; a filter below whatever decodes or detects."""
    return df.where((F.col("frame_idx") + 1) % step == 0)


def seek(df: DataFrame, frame_idx: int) -> DataFrame:
    """One 0-based frame; equality reaches the Parquet scan, while ``read_frames`` takes a range of its own."""
    return df.where(F.col("frame_idx") == frame_idx)


def first_frames(df: DataFrame) -> DataFrame:
    return seek(df, 0)


def frame_totals(frames: DataFrame, keys: list[str], ids: str, step: int) -> DataFrame:
    """Frames, frames on the stride and detections; frames without ids count as frames."""
    return frames.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        F.count_if((F.col("frame_idx") + 1) % step == 0).alias("checked"),
        F.sum(F.coalesce(F.size(F.coalesce(F.col(ids), F.array().cast("array<int>"))), F.lit(0))).cast("long").alias("detections"),
    )


def has_boxes_and_ids(df: DataFrame) -> DataFrame:
    """Tracked frames: boxes and ids both present; apply after counting frames."""
    return df.where(F.col("has_boxes") & F.col("track_ids").isNotNull())


def collect_ordered(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str) -> DataFrame:
    """The rows of each group as an array in emission order."""
    row = F.struct(*order, *[v for v in values if v not in order])
    ordered = F.sort_array(F.collect_list(row))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda r: F.struct(*[r.getField(v).alias(v) for v in values])).alias(name))


def found_flags(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per group, whether there is any result and whether any has a text that isn't blank."""
    return df.groupBy(*keys).agg(
        (F.count("*") > 0).alias("has_result"), F.coalesce(F.bool_or(F.col(text) != ""), F.lit(False)).alias("has_text")
    )


def note_if_empty(df: DataFrame, text: str, name: str = "line") -> DataFrame:
    """One row with ``text`` if ``df`` has none, else no row; a count that stops nothing else."""
    return df.limit(1).agg(F.count("*").alias("many")).where("many = 0").select(F.lit(text).alias(name))


def file_stem(path: Column) -> Column:
    """A file's name without folders and its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def annotated(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    return images.join(annotations.select(key), key, "left_semi")


def unannotated(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    return images.join(annotations.select(key), key, "left_anti")


def match_truth(found: DataFrame, truth: DataFrame, least_iou: float) -> DataFrame:
    """For every true box, the found box of its image with the largest overlap of at least ``least_iou``.

    Found boxes need image_id, pos and bbox; true ones image_id, object_pos and bbox.
    True boxes without such a box stay, with nulls. All pairs of an image are compared,
    so work grows with found times true boxes of an image, some dozens each.
    """
    pairs = truth.alias("t").join(found.alias("f"), "image_id").select(
        "image_id", "object_pos", F.col("f.pos").alias("pos"), boxes.iou(F.col("t.bbox"), F.col("f.bbox")).alias("iou")
    )
    best = best_per_group(pairs.where(F.col("iou") >= least_iou), ["image_id", "object_pos"], "iou", ["pos"])
    return truth.join(best, ["image_id", "object_pos"], "left")
