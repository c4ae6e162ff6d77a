"""The public plans: from images and frames to detections, readings, tracks and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import boxes, text
from lumenframe.operators import detections, models, suppression
from lumenframe.operators.models import ModelSpec
from lumenframe.schema import Settings
from lumenframe.sources import videos
from lumenframe.streaming.tracking import TrackSettings, track

DEFAULT = Settings()


def _kept(images: DataFrame, made: list[str]) -> list[str]:
    """The input's columns but for the image; one that has the name of a result's column is an error."""
    keep = [c for c in images.columns if c != "image"]
    if clash := sorted(set(keep) & set(made)):
        raise ValueError(f"the input has columns of the result's names: {', '.join(clash)}")
    return keep


def _detected(images: DataFrame, model: ModelSpec, made: list[str], most_iou: float | None, **limits) -> tuple[DataFrame, list[str]]:
    """A row per box, and the input's columns to keep; overlapping boxes are suppressed if a limit is given."""
    keep = _kept(images, ["results", "pos", "class_id", "confidence", "xyxy", *made])
    found = models.detect(images, model, **limits).drop("image")
    found = found if most_iou is None else suppression.suppress_results(found, most_iou)
    return detections.flatten_results(found), keep


def detect_vehicles(images: DataFrame, model: ModelSpec, settings: Settings = DEFAULT, most_iou: float | None = None) -> DataFrame:
    """One row per vehicle with class, confidence, bbox and its position; the class limit goes into the model stage.

    ``most_iou`` suppresses boxes of a class that overlap a better one by more, for models that leave that out.
    """
    found, keep = _detected(images, model, ["class", "bbox"], most_iou, classes=list(settings.classes))
    labelled = detections.keep_classes(found, settings).withColumn("bbox", boxes.to_int_box(F.col("xyxy")))
    return labelled.select(*keep, "pos", "class", "confidence", "bbox")


def detect_plates(images: DataFrame, model: ModelSpec, least: float | None = None, most_iou: float | None = None) -> DataFrame:
    """One row per plate with confidence and bbox; no threshold, and no suppression, unless one is given."""
    found, keep = _detected(images, model, ["bbox"], most_iou, least=least)
    return found.select(*keep, "pos", "confidence", boxes.to_int_box(F.col("xyxy")).alias("bbox"))


def reading_of(docs: Column) -> list[Column]:
    best = text.best_reading(docs)
    return [best.getField("text").alias("text"), best.getField("score").alias("ocr_confidence")]


def detect_and_read(
    images: DataFrame, detector: ModelSpec, ocr: ModelSpec, settings: Settings = DEFAULT, variable_scale: bool = True
) -> DataFrame:
    """One row per readable plate: text ('' if none is found), both confidences, bbox and crop_bbox.

    The whole plan is one pass over the images without a shuffle: one stage detects
    and crops, so that images go no further, one reads the crops, and the best text
    is chosen by a fold within the row, so nothing is joined back. ``bbox`` is the
    detector's box cast to whole numbers, ``crop_bbox`` what of it lies in the image.
    """
    keep = _kept(images, ["crops", "pos", "confidence", "xyxy", "docs", "text", "detection_confidence", "ocr_confidence", "bbox", "crop_bbox", "crop"])
    found = models.detect_crops(images.where(F.col("image").isNotNull()), detector, settings.min_confidence)
    one = detections.unused(keep, "one")
    cropped = found.select(*keep, F.explode("crops").alias(one)).select(*keep, *[f"{one}.{c}" for c in ("pos", "confidence", "xyxy", "bbox", "crop")])
    read = models.read_plates(cropped, ocr, settings, variable_scale)
    best = detections.unused(read.columns, "best")
    return read.withColumn(best, text.best_reading(F.col("docs"))).select(
        *keep,
        "pos",
        F.col(f"{best}.text").alias("text"),
        F.col("confidence").alias("detection_confidence"),
        F.col(f"{best}.score").alias("ocr_confidence"),
        boxes.to_int_box(F.col("xyxy")).alias("bbox"),
        F.col("bbox").alias("crop_bbox"),
    )


def best_plate(images: DataFrame, detector: ModelSpec, key: str) -> DataFrame:
    """The most confident plate of each image, by a confidence above 0 only; images without one give no row."""
    found = detect_plates(images, detector)
    return detections.best_per_group(found, [key], "confidence", ["pos"])


def export_best_plates(images: DataFrame, detector: ModelSpec, key: str, settings: Settings = DEFAULT, margins: bool = False, scale: float = 1.0) -> DataFrame:
    """The crop of each image's best plate, with margins and enlarged if asked for; sinks can write ``image``.

    One pass: the stage that detects also cuts, so images are neither joined nor read again.
    """

    def widened(box: list[int], width: int, height: int) -> list[int]:
        dx, dy = int((box[2] - box[0]) * settings.margin_x), int((box[3] - box[1]) * settings.margin_y)
        return [box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy] if margins else box

    only = images.select(F.col(key).alias("key"), "image")
    best = models.best_crops(only.where(F.col("image").isNotNull()), detector, widened, scale).where(F.col("best").isNotNull())
    return best.select(F.col("key").alias(key), "best.confidence", "best.bbox", F.col("best.crop").alias("image"))


def read_whole(images: DataFrame, ocr: ModelSpec, key: str) -> DataFrame:
    """OCR of whole images: every non-blank text with its score, and whether there was any result."""
    docs = models.read_text(images, ocr).drop("image")
    pairs = F.flatten(F.transform("docs", lambda d: text.zip_shortest(d.getField("rec_texts"), d.getField("rec_scores"))))
    return docs.select(key, (F.size("docs") > 0).alias("has_result"), text.nonblank(pairs).alias("texts"), F.to_json("docs").alias("raw"))


def strided_plates(frames: DataFrame, detector: ModelSpec, settings: Settings = DEFAULT) -> DataFrame:
    """Plates of every ``stride``-th frame; the detector sees no other.

    The filter is above the source, which decodes all frames it is asked for; give
    ``read_frames`` the same stride and the others are not decoded either.
    """
    return detect_plates(detections.stride(frames, settings.stride), detector)


def track_vehicles(frames: DataFrame, detector: ModelSpec, settings: Settings = DEFAULT, tracking: TrackSettings = TrackSettings()) -> DataFrame:
    """Track ids of every frame; classes are limited before association."""
    found = models.detect(frames, detector, classes=list(settings.classes)).select("video_id", "frame_idx", F.flatten("results").alias("boxes"))
    return track(found, tracking)


def tracking_report(tracked: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per video: frames, frames on the stride, the sum of detections, and distinct tracks."""
    distinct = tracked.select("video_id", F.explode("track_ids").alias("id")).groupBy("video_id").agg(F.countDistinct("id").alias("tracks"))
    totals = detections.frame_totals(tracked, ["video_id"], "track_ids", settings.stride)
    return totals.join(distinct, "video_id", "left").withColumn("tracks", F.coalesce("tracks", F.lit(0)))


def annotated_frames(frames: DataFrame, detector: ModelSpec, settings: Settings = DEFAULT, labels: bool = True) -> DataFrame:
    """Frames with their boxes drawn, and with class and confidence as labels, ready for a video or image sink."""
    keep = _kept(frames, ["results", "boxes", "labels"])
    found = models.detect(frames, detector, classes=list(settings.classes)).withColumn("boxes", F.flatten("results"))
    return _drawn(found, "boxes", _named(settings), labels).select(*keep, "image")


def annotated_tracks(frames: DataFrame, tracked: DataFrame, settings: Settings = DEFAULT, labels: bool = True) -> DataFrame:
    """Frames with tracked boxes drawn, labelled by track id and class.

    ``tracked`` has video_id, frame_idx, boxes and box_ids in the order of the boxes; boxes without an id aren't drawn.
    """
    keep = _kept(frames, ["boxes", "box_ids", "labels"])
    both = frames.join(tracked.select("video_id", "frame_idx", "boxes", "box_ids"), ["video_id", "frame_idx"], "left")
    pairs = F.arrays_zip(F.col("boxes").alias("box"), F.col("box_ids").alias("id"))
    known = F.transform(F.filter(pairs, lambda p: p.getField("id").isNotNull()), lambda p: F.struct(p.getField("id").alias("id"), p.getField("box").alias("box")))
    name = lambda p: F.concat(F.lit("id:"), p.getField("id").cast("string"), F.lit(" "), _named(settings)(p.getField("box")))
    drawn = both.withColumn("boxes", known)
    texts = F.transform("boxes", name) if labels else F.lit(None).cast("array<string>")
    drawn = drawn.withColumn("labels", texts).withColumn("boxes", F.transform("boxes", lambda p: boxes.to_int_box(p.getField("box").getField("xyxy"))))
    return models.annotate(drawn, labels="labels").select(*keep, "image")


def _named(settings: Settings):
    """Gives for a box its class's name, or its number, and its confidence with two places."""

    def name(box: Column) -> Column:
        label = F.coalesce(boxes.class_label(box.getField("class_id"), settings.classes), box.getField("class_id").cast("string"), F.lit("?"))
        return F.concat_ws(" ", label, F.format_string("%.2f", box.getField("confidence")))

    return name


def _drawn(found: DataFrame, column: str, name, labels: bool) -> DataFrame:
    texts = F.transform(column, name) if labels else F.lit(None).cast("array<string>")
    drawn = found.withColumn("labels", texts).withColumn("boxes", F.transform(column, lambda b: boxes.to_int_box(b.getField("xyxy"))))
    return models.annotate(drawn, labels="labels")


def track_boxes(frames: DataFrame, detector: ModelSpec, settings: Settings = DEFAULT, tracking: TrackSettings = TrackSettings()) -> DataFrame:
    """video_id, frame_idx, boxes and box_ids of every frame: what ``annotated_tracks`` draws."""
    found = models.detect(frames, detector, classes=list(settings.classes)).select("video_id", "frame_idx", F.flatten("results").alias("boxes"))
    return found.join(track(found, tracking).select("video_id", "frame_idx", "box_ids"), ["video_id", "frame_idx"])


def tracked_videos(
    frames: DataFrame, detector: ModelSpec, folder: str, settings: Settings = DEFAULT, tracking: TrackSettings = TrackSettings(), labels: bool = True
) -> DataFrame:
    """Videos of the frames with tracked boxes drawn, written below ``folder``: (video_id, path, frames).

    Frames are read twice, to track and to draw, so that boxes alone are shuffled for
    tracking; drawn frames are shuffled once, by ranges that tasks encode.
    """
    return videos.write_videos(annotated_tracks(frames, track_boxes(frames, detector, settings, tracking), settings, labels), folder)
