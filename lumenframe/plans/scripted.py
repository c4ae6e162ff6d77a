"""The public plans on scripted models, each with the SQL that gives the same rows.

Every embedding becomes an image of 24 x 16 pixels whose bytes repeat the md5 of
its vec_id. The scripted detector gives boxes by the first byte, so SQL can tell
them; the scripted OCR answers by the size or the first byte of what it is given.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import boxes, display, text
from lumenframe.operators import detections, models
from lumenframe.operators.models import ModelSpec, ScriptedDetector
from lumenframe.plans import pipelines
from lumenframe.plans.catalogue import ORACLE_SQL, QUERIES, SETTINGS, query, table
from lumenframe.schema import OCR_DOC
from lumenframe.sources import frames as frame_files
from lumenframe.sources import images as image_files
from lumenframe.sources import sinks, videos, voc
from lumenframe.sources.jpeg import encode_jpeg
from lumenframe.workspace import deal, scratch

__all__ = ["ORACLE_SQL", "QUERIES"]  # those of the catalogue, with this module's

WIDTH, HEIGHT = 24, 16
#: Class ids that the script deals out; the first is no vehicle.
DEALT_CLASSES = (0, 2, 3, 5, 7)


def _boxes(first: int) -> list[list[tuple]]:
    """Up to three boxes of an image by its first byte, in two results; some reach beyond the image, some are empty."""
    found = []
    for j in range(first % 4):
        x, y = first % 10 + 5 * j - 2.5, 3 * j - 1.5
        found.append((DEALT_CLASSES[(first + j) % 5], (first * 7 + j * 3) % 20 / 20, x, y, x + (first + j) % 9, y + 4 + first % 8))
    return [found[:1], found[1:]]


#: The same boxes in SQL: j is the box's number in its image.
_IMAGES = """SELECT vec_id, m, (strpos('0123456789abcdef', m[1]) - 1) * 16 + strpos('0123456789abcdef', m[2]) - 1 AS k
    FROM (SELECT vec_id, md5(vec_id::VARCHAR) AS m FROM embeddings)"""
_RAW = f"""SELECT *, x + (k + j) % 9 AS u, y + 4 + k % 8 AS v FROM (SELECT vec_id, m, k, j::INT AS j,
    CASE (k + j) % 5 WHEN 1 THEN 'car' WHEN 2 THEN 'motorcycle' WHEN 3 THEN 'bus' WHEN 4 THEN 'truck' END AS class,
    ((k * 7 + j * 3) % 20) / 20.0::DOUBLE AS confidence, k % 10 + 5 * j - 2.5::DOUBLE AS x, 3 * j - 1.5::DOUBLE AS y
    FROM ({_IMAGES}), range(3) t(j) WHERE j < k % 4)"""
_WHOLE = ", ".join(f"trunc({c})::INT AS {name}" for c, name in (("x", "x1"), ("y", "y1"), ("u", "x2"), ("v", "y2")))
_BOXES = f"SELECT vec_id, m, k, j, class, confidence, {_WHOLE} FROM ({_RAW})"
_INSIDE = f"""SELECT vec_id, m, k, j, confidence, least(greatest(x1, 0), {WIDTH}) AS x1, least(greatest(y1, 0), {HEIGHT}) AS y1,
    least(greatest(x2, 0), {WIDTH}) AS x2, least(greatest(y2, 0), {HEIGHT}) AS y2"""


class SizeOcr:
    """Reads the width and height of the enhanced image, with a blank text between them and a score too many."""

    def predict(self, images):
        return [
            [{"rec_texts": [f" W{i.shape[1]} ", " "], "rec_scores": [i.shape[1] % 16 / 16, 0.95, 1.0]}, {"rec_texts": [f"H{i.shape[0]}"], "rec_scores": [i.shape[0] % 16 / 16]}]
            for i in images
        ]


class ByteOcr:
    """Reads the first byte; every fourth image has no result, and every second document is a function that returns it."""

    def predict(self, images):
        out = []
        for image in images:
            k = int(image.flat[0])
            doc = {"rec_texts": [f" P{k}", "", "Q"], "rec_scores": [k / 256, 0.5]}
            out.append([] if k % 4 == 0 else [doc if k % 2 else lambda doc=doc: doc])
        return out


def _detector() -> ModelSpec:
    return ModelSpec(ScriptedDetector, ({k: _boxes(k) for k in range(256)},))


def images(spark, sf_dir) -> DataFrame:
    data = F.unhex(F.repeat(F.md5(F.col("vec_id").cast("string").cast("binary")), WIDTH * HEIGHT * 3 // 16))
    image = F.struct(F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(3).alias("n_channels"), data.alias("data"))
    return deal(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id").select("vec_id", image.alias("image"))


def frames(spark, sf_dir) -> DataFrame:
    """The images as frames of videos of a hundred."""
    video = F.floor(F.col("vec_id") / 100).cast("string")
    return images(spark, sf_dir).select(video.alias("video_id"), (F.col("vec_id") % 100).alias("frame_idx"), F.lit(25.0).alias("fps"), "image")


def _corners() -> list:
    return [boxes.corner(F.col("bbox"), k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]


@query(f"""SELECT vec_id, cast(row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS INT) AS pos, class, confidence, x1, y1, x2, y2
    FROM ({_BOXES}) WHERE class IS NOT NULL""")
def plan_detect_vehicles(spark, sf_dir):
    found = pipelines.detect_vehicles(images(spark, sf_dir), _detector())
    return found.select("vec_id", "pos", "class", "confidence", *_corners())


@query(f"""SELECT vec_id, cast(row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS INT) AS pos, confidence, x1, y1, x2, y2
    FROM ({_BOXES}) WHERE confidence >= 0.25""")
def plan_detect_plates(spark, sf_dir):
    found = pipelines.detect_plates(images(spark, sf_dir), _detector(), SETTINGS.min_confidence)
    return found.select("vec_id", "pos", "confidence", *_corners())


@query(f"""WITH found AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS pos FROM ({_BOXES}) WHERE confidence >= 0.25),
    inside AS (SELECT *, least(greatest(x1, 0), {WIDTH}) AS a1, least(greatest(y1, 0), {HEIGHT}) AS b1,
    least(greatest(x2, 0), {WIDTH}) AS a2, least(greatest(y2, 0), {HEIGHT}) AS b2 FROM found),
    sized AS (SELECT *, least(5.0::DOUBLE, 3800.0::DOUBLE / greatest(a2 - a1, b2 - b1)) AS s FROM inside WHERE a2 > a1 AND b2 > b1),
    enlarged AS (SELECT *, trunc((a2 - a1) * s)::INT AS w, trunc((b2 - b1) * s)::INT AS h FROM sized)
    SELECT vec_id, pos::INT AS pos, CASE WHEN greatest(w % 16, h % 16) = 0 THEN '' WHEN w % 16 >= h % 16 THEN 'W' || w ELSE 'H' || h END AS text,
    confidence AS detection_confidence, greatest(w % 16, h % 16) / 16.0::DOUBLE AS ocr_confidence, x1, y1, x2, y2,
    a1 || ',' || b1 || ',' || a2 || ',' || b2 AS crop FROM enlarged""")
def plan_detect_and_read(spark, sf_dir):
    """Detect, crop, enlarge, equalise, read and choose: the OCR reads the size of what it is given."""
    read = pipelines.detect_and_read(images(spark, sf_dir), _detector(), ModelSpec(SizeOcr))
    crop = F.array_join(F.col("crop_bbox").cast("array<string>"), ",").alias("crop")
    return read.select("vec_id", "pos", "text", "detection_confidence", "ocr_confidence", *_corners(), crop)


_BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, j) AS r
    FROM ({_BOXES}) WHERE confidence > 0) WHERE r = 1"""


@query(f"SELECT vec_id, j AS pos, confidence, x1, y1, x2, y2 FROM ({_BEST})")
def plan_best_plate(spark, sf_dir):
    best = pipelines.best_plate(images(spark, sf_dir), _detector(), "vec_id")
    return best.select("vec_id", "pos", "confidence", *_corners())


_MARGINS = f"""SELECT vec_id, m, k, j, confidence, x1 - cast(trunc((x2 - x1) * 0.15::DOUBLE) AS INT) AS x1,
    y1 - cast(trunc((y2 - y1) * 0.25::DOUBLE) AS INT) AS y1, x2 + cast(trunc((x2 - x1) * 0.15::DOUBLE) AS INT) AS x2,
    y2 + cast(trunc((y2 - y1) * 0.25::DOUBLE) AS INT) AS y2 FROM ({_BEST})"""


@query(f"""WITH crops AS (SELECT * FROM ({_INSIDE} FROM ({_MARGINS})) WHERE x2 > x1 AND y2 > y1)
    SELECT vec_id, confidence, x1, y1, x2, y2, x2 - x1 AS width, y2 - y1 AS height,
    string_agg(substr(repeat(m, 72), cast(2 * ({WIDTH * 3} * y + 3 * x1) + 1 AS INT), 6 * (x2 - x1)), '' ORDER BY y) AS pixels
    FROM crops, range({HEIGHT}) t(y) WHERE y >= y1 AND y < y2 GROUP BY vec_id, confidence, x1, y1, x2, y2""")
def plan_export_best(spark, sf_dir):
    """The crop of the best plate with its margins, compared byte for byte."""
    crop = pipelines.export_best_plates(images(spark, sf_dir), _detector(), "vec_id", margins=True)
    return crop.select(
        "vec_id", "confidence", *_corners(), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.lower(F.hex("image.data")).alias("pixels")
    )


@query(f"""SELECT vec_id, k % 4 <> 0 AS has_result, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS n_texts,
    CASE WHEN k % 4 <> 0 THEN 'P' || k END AS text, CASE WHEN k % 4 <> 0 THEN k / 256.0::DOUBLE END AS score,
    CASE WHEN k % 4 = 0 THEN '[]' ELSE '[{{"rec_texts":[" P' || k || '","","Q"],"rec_scores":[' || (k / 256.0::DOUBLE) || ',0.5]}}]' END AS raw
    FROM ({_IMAGES})""")
def plan_read_whole(spark, sf_dir):
    read = pipelines.read_whole(images(spark, sf_dir), ModelSpec(ByteOcr), "vec_id")
    first = F.get("texts", F.lit(0))
    return read.select(
        "vec_id", "has_result", F.size("texts").alias("n_texts"), first.getField("text").alias("text"), first.getField("score").alias("score"), "raw"
    )


@query(f"""SELECT (vec_id // 100)::VARCHAR AS video_id, vec_id % 100 AS frame_idx, j AS pos, confidence, x1, y1, x2, y2
    FROM ({_BOXES}) WHERE (vec_id % 100 + 1) % 10 = 0""")
def plan_strided_plates(spark, sf_dir):
    found = pipelines.strided_plates(frames(spark, sf_dir), _detector())
    return found.select("video_id", "frame_idx", "pos", "confidence", *_corners())


@query("""SELECT event_type AS video_id, count(*) AS frames, count(*) FILTER ((event_id + 1) % 10 = 0) AS checked,
    sum(CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id % 4 + 1 END)::BIGINT AS detections,
    coalesce(max(CASE WHEN user_id % 5 <> 0 THEN user_id % 4 + 1 END), 0)::BIGINT AS tracks FROM events GROUP BY event_type""")
def plan_tracking_report(spark, sf_dir):
    ids = F.when(F.col("user_id") % 5 != 0, F.sequence(F.lit(0), (F.col("user_id") % 4).cast("int")))
    tracked = table(spark, sf_dir, "events").select(F.col("event_type").alias("video_id"), F.col("event_id").alias("frame_idx"), ids.alias("track_ids"))
    return pipelines.tracking_report(tracked)


@query("SELECT event_id, user_id % 4 + 1 AS n_ids FROM events WHERE value > 10 AND user_id % 5 <> 0")
def boxes_and_ids(spark, sf_dir):
    """Frames with boxes and track ids; a frame without boxes, or of which no box has an id, is left out."""
    ids = F.when(F.col("user_id") % 5 != 0, F.sequence(F.lit(0), (F.col("user_id") % 4).cast("int")))
    seen = table(spark, sf_dir, "events").withColumn("has_boxes", F.col("value") > 10).withColumn("track_ids", ids)
    return detections.has_boxes_and_ids(seen).select("event_id", F.size("track_ids").cast("long").alias("n_ids"))


@query("SELECT event_id, printf('%.2f', value) AS shown, 2 AS first_class, '2,3,5,7' AS classes FROM events")
def display_values(spark, sf_dir):
    """Two places of a number, and the class ids as the detector is given them."""
    ids = boxes.class_ids(SETTINGS.classes)
    return table(spark, sf_dir, "events").select(
        "event_id",
        display.two_places("value").alias("shown"),
        boxes.first_item(ids).alias("first_class"),
        F.array_join(ids.cast("array<string>"), ",").alias("classes"),
    )


@query("""SELECT event_id, event_id % 4 = 3 AS has_texts, CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END AS n_texts,
    CASE WHEN event_id % 4 = 3 THEN event_type ELSE '' END AS text FROM events""")
def absent_lists(spark, sf_dir):
    """OCR documents of which the lists are absent, null, empty or filled; blank texts are left out."""
    kind = F.col("event_id") % 4
    filled = F.concat(F.lit('{"rec_texts": ["", "'), "event_type", F.lit('"], "rec_scores": [0.9, 0.5]}'))
    json = F.when(kind == 0, "{}").when(kind == 1, '{"rec_texts": null, "rec_scores": null}').when(kind == 2, '{"rec_texts": [], "rec_scores": [0.5]}').otherwise(filled)
    docs = table(spark, sf_dir, "events").select("event_id", text.parse_doc(json).cast(OCR_DOC).alias("doc"))
    shown = text.nonblank(text.zip_shortest(F.col("doc.rec_texts"), F.col("doc.rec_scores")))
    best = text.best_reading(F.array("doc"))
    return docs.select("event_id", (F.size(shown) > 0).alias("has_texts"), F.size(shown).alias("n_texts"), best.getField("text").alias("text"))


def _folder(spark, name: str) -> str:
    """The URI of an unused folder."""
    folder = scratch(spark, name)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


@query(f"""SELECT vec_id::VARCHAR AS stem, {HEIGHT} AS height, {WIDTH} AS width, repeat(m, 72) AS pixels FROM ({_IMAGES})""")
def image_files_round_trip(spark, sf_dir):
    """Every image written as a file of its own, and all files read back by their paths."""
    folder = _folder(spark, "images")
    # the write has to be over before the folder is listed
    sinks.write_images(images(spark, sf_dir), folder, "vec_id").write.format("noop").mode("overwrite").save()
    read = image_files.readable(image_files.read_images(spark, folder, glob="*.ppm"))
    return read.select(
        detections.file_stem(F.col("path")).alias("stem"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.lower(F.hex("image.data")).alias("pixels")
    )


@query(f"""SELECT vec_id, (j + 1) || '. ' || class || ' ' || printf('%.2f', confidence) || ' (' || x1 || ', ' || y1 || ', ' || x2 || ', ' || y2 || ')' AS line
    FROM (SELECT vec_id, class, confidence, x1, y1, x2, y2, row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS j FROM ({_BOXES}) WHERE class IS NOT NULL)""")
def report_lines(spark, sf_dir):
    """Display lines of numbered detections."""
    found = pipelines.detect_vehicles(images(spark, sf_dir), _detector())
    return sinks.detection_lines(detections.number_rows(found, ["vec_id"], ["pos"]), ["vec_id"])


@query(f"""SELECT vec_id::VARCHAR AS stem, {HEIGHT} AS height, {WIDTH} AS width, repeat(m, 72) AS pixels FROM ({_IMAGES})""")
def png_files_round_trip(spark, sf_dir):
    """Every image written as a PNG file, and all files decoded again, compared pixel by pixel."""
    folder = _folder(spark, "png")
    sinks.write_images(images(spark, sf_dir), folder, "vec_id", suffix=".png").write.format("noop").mode("overwrite").save()
    read = image_files.readable(image_files.read_images(spark, folder, glob="*.png"))
    return read.select(
        detections.file_stem(F.col("path")).alias("stem"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.lower(F.hex("image.data")).alias("pixels")
    )


#: Quality at which the quantisation table is the standard's own, and its first step, that of a block's mean.
HALF_QUALITY, MEAN_STEP = 50, 16


@query(f"""SELECT vec_id::VARCHAR AS stem, p::INT AS block, repeat(printf('%02x', g), 64) AS pixels FROM (SELECT vec_id, p,
    greatest(0, least(255, floor(round_even((v - 128) * 8 / {MEAN_STEP}.0::DOUBLE, 0) * {MEAN_STEP} / 8 + 128.5::DOUBLE)))::INT AS g
    FROM (SELECT vec_id, p, least(255, floor(abs(embedding[p + 1]::DOUBLE) * 400)) AS v FROM embeddings, range(64) t(p)))""")
def jpeg_blocks(spark, sf_dir):
    """Each embedding as an image of 8 x 8 blocks of one gray, written as JPEG files and decoded again.

    Such a block has one coefficient, so SQL can tell what quantising leaves of it.
    """
    gray = F.transform("embedding", lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 400)).cast("int"))
    digits = F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), "")
    row = lambda r: F.repeat(F.concat(*[F.repeat(F.substring("digits", 16 * r + 2 * c + 1, 2), 8) for c in range(8)]), 8)
    data = F.unhex(F.concat(*map(row, range(8))))
    image = F.struct(F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))
    folder = _folder(spark, "jpeg")
    blocks = deal(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").select("vec_id", digits.alias("digits")).select("vec_id", image.alias("image"))
    half = functools.partial(encode_jpeg, quality=HALF_QUALITY)
    sinks.write_images(blocks, folder, "vec_id", half, ".jpg").write.format("noop").mode("overwrite").save()
    read = image_files.readable(image_files.read_images(spark, folder, glob="*.jpg"))
    flat = read.select(detections.file_stem(F.col("path")).alias("stem"), F.col("image.data").alias("data"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("block"))
    # of bytes, 64 a row: of a string, substring walks all characters before the place
    corner = 512 * F.floor(F.col("block") / 8) + 8 * (F.col("block") % 8) + 1
    rows = [F.substring("data", (corner + 64 * y).cast("int"), F.lit(8)) for y in range(8)]
    return flat.select("stem", "block", F.lower(F.hex(F.concat(*rows))).alias("pixels"))


_GREEN = f"""SELECT vec_id, p, count(b.j) > 0 AS drawn, any_value(substr(repeat(m, 72), cast(6 * p + 1 AS INT), 6)) AS old
    FROM ({_IMAGES}) i CROSS JOIN range({WIDTH * HEIGHT}) t(p) LEFT JOIN (SELECT vec_id AS of, j, x1, y1, x2, y2 FROM ({_BOXES}) WHERE class IS NOT NULL) b
    ON b.of = vec_id AND ((p % {WIDTH} >= x1 AND p % {WIDTH} < x2 AND p // {WIDTH} IN (y1, y1 + 1, y2 - 2, y2 - 1))
    OR (p // {WIDTH} >= y1 AND p // {WIDTH} < y2 AND p % {WIDTH} IN (x1, x1 + 1, x2 - 2, x2 - 1))) GROUP BY vec_id, p"""


@query(f"SELECT vec_id, string_agg(CASE WHEN drawn THEN '00ff00' ELSE old END, '' ORDER BY p) AS pixels FROM ({_GREEN}) GROUP BY vec_id")
def annotated_frames(spark, sf_dir):
    """The outlines of vehicles on every image, two points wide and clipped, compared pixel by pixel."""
    drawn = pipelines.annotated_frames(images(spark, sf_dir), _detector(), labels=False)
    return drawn.select("vec_id", F.lower(F.hex("image.data")).alias("pixels"))


#: A scene of a hundred frames: two vehicles that pass each other, one of them hidden and later faint, a third that comes late, and a person.
HIDDEN, FAINT, LATE = range(40, 45), 60, 70


def _scene(k: int) -> list[list[tuple]]:
    found = [(0, 0.9, 10.0, 200.0, 30.0, 260.0), (2, 0.9, 3.0 * k, 0.0, 3.0 * k + 40, 30.0)]
    if k not in HIDDEN:
        found.append((7, 0.3 if k == FAINT else 0.8, 300.0 - 3 * k, 40.0, 360.0 - 3 * k, 90.0))
    if k >= LATE:
        found.append((5, 0.7, 500.0, 100.0 + k, 560.0, 160.0 + k))
    return [found]


def _scenes(spark, sf_dir, side: int = 1) -> DataFrame:
    """The frames of such scenes as black squares, of which the first byte tells the script the frame's number."""
    data = F.unhex(F.rpad(F.lpad(F.hex(F.col("frame_idx")), 2, "0"), 6 * side * side, "0"))
    image = F.struct(F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("n_channels"), data.alias("data"))
    return frames(spark, sf_dir).withColumn("image", image)


def _watcher() -> ModelSpec:
    return ModelSpec(ScriptedDetector, ({k: _scene(k) for k in range(100)},))


@query(f"""SELECT (vec_id // 100)::VARCHAR AS video_id, vec_id % 100 AS frame_idx, true AS has_boxes, '1'
    || CASE WHEN vec_id % 100 BETWEEN {HIDDEN.start} AND {HIDDEN.stop - 1} THEN '' ELSE ',2' END
    || CASE WHEN vec_id % 100 > {LATE} THEN ',3' ELSE '' END AS track_ids FROM embeddings""")
def track_vehicles(spark, sf_dir):
    """Ids of vehicles through crossing, hiding, a faint frame and a late arrival, which a second frame confirms; the person is left out."""
    tracked = pipelines.track_vehicles(_scenes(spark, sf_dir), _watcher())
    return tracked.select("video_id", "frame_idx", "has_boxes", F.array_join(F.col("track_ids").cast("array<string>"), ",").alias("track_ids"))


#: A square frame of one gray, the first byte of the md5; at the usual quality JPEG keeps it exactly.
_GRAYS = f"""SELECT (vec_id // 100)::VARCHAR AS video, vec_id % 100 AS frame_idx, 25.0::DOUBLE AS fps, 16 AS height, 16 AS width,
    repeat(substr(m, 1, 2), 256) AS pixels FROM ({_IMAGES})"""


def _videos(spark, sf_dir) -> str:
    """The folder of AVI files of such frames, one for each hundred embeddings."""
    data = F.unhex(F.repeat(F.substring(F.hex("image.data"), 1, 2), 256))
    gray = F.struct(F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))
    folder = _folder(spark, "videos")
    videos.write_videos(frames(spark, sf_dir).withColumn("image", gray), folder)
    return folder


def _shown(seen: DataFrame) -> DataFrame:
    size = [F.col(f"image.{c}").alias(c) for c in ("height", "width")]
    return seen.select(detections.file_stem(F.col("video_id")).alias("video"), "frame_idx", "fps", *size, F.lower(F.hex("image.data")).alias("pixels"))


@query(_GRAYS)
def videos_round_trip(spark, sf_dir):
    """Videos written in segments and stitched, then planned and decoded by tasks."""
    return _shown(frame_files.read_videos(videos.list_videos(spark, _videos(spark, sf_dir))))


@query(f"SELECT * FROM ({_GRAYS}) WHERE (frame_idx + 1) % 10 = 0")
def videos_strided(spark, sf_dir):
    """Every tenth frame of the same videos; no other is decoded."""
    return _shown(frame_files.read_videos(videos.list_videos(spark, _videos(spark, sf_dir)), stride=SETTINGS.stride))


@query("SELECT (vec_id // 100)::VARCHAR AS video, 25.0::DOUBLE AS fps, 16 AS height, 16 AS width, count(*) AS frames FROM embeddings GROUP BY vec_id // 100")
def video_metadata(spark, sf_dir):
    """What the headers of the same videos say, read by tasks."""
    manifest = frame_files.video_manifest(videos.list_videos(spark, _videos(spark, sf_dir)))
    return manifest.select(detections.file_stem(F.col("video_id")).alias("video"), "fps", "height", "width", "frames")


_LINES = f"""SELECT vec_id, j + 1 AS n, (j + 1) || '. ' || class || ' ' || printf('%.2f', confidence) || ' (' || x1 || ', ' || y1 || ', ' || x2 || ', ' || y2 || ')' AS line,
    confidence FROM (SELECT vec_id, class, confidence, x1, y1, x2, y2, row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS j FROM ({_BOXES}) WHERE class IS NOT NULL)"""


@query(f"""WITH l AS ({_LINES}) SELECT 0 AS section, NULL::BIGINT AS vec_id, NULL::BIGINT AS n, 0 AS part, '===== VEHICLES =====' AS line UNION ALL
    SELECT 1, vec_id, n, 0, line FROM l UNION ALL SELECT 2, NULL, NULL, 0, 'Images with vehicles: ' || count(DISTINCT vec_id) FROM l UNION ALL
    SELECT 2, NULL, NULL, 1, 'Vehicles: ' || count(*) FROM l UNION ALL SELECT 3, NULL, NULL, 0, repeat('=', 20)""")
def console_report(spark, sf_dir):
    """The report of all vehicles: banner, lines, totals and a rule."""
    found = detections.number_rows(pipelines.detect_vehicles(images(spark, sf_dir), _detector()), ["vec_id"], ["pos"])
    lines = sinks.detection_lines(found, ["vec_id", "n"])
    totals = {"Images with vehicles": F.count_distinct("vec_id"), "Vehicles": F.count("*")}
    return sinks.report(lines, "line", ["vec_id", "n"], "VEHICLES", "No vehicles.", totals)


@query("SELECT vec_id, array_to_string(list_transform(embedding[1:6], lambda v: trunc(v::DOUBLE * 100)::INT), ',') AS ids FROM embeddings")
def whole_ids(spark, sf_dir):
    """A model's numbers as whole ones; truncation differs from rounding below zero."""
    ids = boxes.to_ints(F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double") * 100))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query(f"""SELECT vec_id::VARCHAR || '.jpg' AS filename, j AS object_pos, {WIDTH} AS width, {HEIGHT} AS height, coalesce(class, 'other') AS name,
    x AS xmin, y AS ymin, u AS xmax, v AS ymax, CASE WHEN j <> 1 THEN 'T' || k END AS text, (k / 8.0::DOUBLE)::VARCHAR AS rotation FROM ({_RAW})""")
def voc_objects(spark, sf_dir):
    """Boxes written as Pascal VOC annotations and read back, one row an object; the second of an image has no text attribute."""
    class_of = F.coalesce(boxes.class_label(F.col("class_id"), SETTINGS.classes), F.lit("other"))
    first = F.conv(F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 2), 16, 10)
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    attribute = lambda name, value: tag("attribute", tag("name", F.lit(name)), tag("value", value))
    bounds = [tag(c, boxes.corner(F.col("xyxy"), k).cast("string")) for k, c in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    text_of = F.when(F.col("pos") != 1, attribute("number_plate_text", F.concat(F.lit("T"), first))).otherwise("")
    flags = [tag(c, F.lit("0")) for c in ("truncated", "occluded", "difficult")]
    one = tag("object", tag("name", class_of), *flags, tag("bndbox", *bounds), tag("attributes", text_of, attribute("rotation", (first / 8).cast("string"))))
    found = detections.flatten_results(models.detect(images(spark, sf_dir), _detector()).drop("image")).select("vec_id", "pos", one.alias("one"))
    found = deal(found, "vec_id")  # the listing keeps this, so as many tasks write the files
    listed = detections.collect_ordered(found, ["vec_id"], ["pos"], ["one"], "objects")
    # the source holds a tag of the row's own name, which must not begin a row
    source = tag("source", *[tag(c, F.lit("x")) for c in ("database", "annotation", "image")])
    size = tag("size", tag("width", F.lit(str(WIDTH))), tag("height", F.lit(str(HEIGHT))), tag("depth", F.lit("")))
    name = tag("filename", F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")))
    objects = F.array_join(F.transform("objects", lambda o: o.getField("one")), "")
    folder = _folder(spark, "voc")
    whole = tag("annotation", tag("folder", F.lit("f")), name, source, size, tag("segmented", F.lit("0")), objects)
    sinks.write_texts(listed.select("vec_id", whole.alias("whole")), folder, "vec_id", "whole", ".xml").write.format("noop").mode("overwrite").save()
    read = voc.plate_texts(voc.annotation_objects(voc.read_annotations(spark, folder)))
    rotation = F.try_element_at("attrs", F.lit("rotation")).alias("rotation")
    return read.select("filename", "object_pos", "width", "height", "name", "xmin", "ymin", "xmax", "ymax", "text", rotation)


@query(f"SELECT count(*) AS images, count(*) FILTER (k % 5 = 0) AS unreadable FROM ({_IMAGES})")
def unreadable_files(spark, sf_dir):
    """Image files of which some are cut off after their headers: these have a null image and are counted."""
    folder = _folder(spark, "damaged")

    def encode(array):
        data = encode_jpeg(array)
        return data[: len(data) // 2] if int(array.flat[0]) % 5 == 0 else data

    sinks.write_images(images(spark, sf_dir), folder, "vec_id", encode, ".jpg").write.format("noop").mode("overwrite").save()
    return image_files.unreadable_count(image_files.read_images(spark, folder))


@query(f"SELECT vec_id::VARCHAR AS stem, string_agg(CASE WHEN drawn THEN '00ff00' ELSE old END, '' ORDER BY p) AS pixels FROM ({_GREEN}) GROUP BY vec_id")
def annotated_files(spark, sf_dir):
    """Annotated images saved as files and read back."""
    folder = _folder(spark, "annotated")
    drawn = pipelines.annotated_frames(images(spark, sf_dir), _detector(), labels=False)
    sinks.write_images(drawn, folder, "vec_id", suffix=".png").write.format("noop").mode("overwrite").save()
    read = image_files.readable(image_files.read_images(spark, folder))
    return read.select(detections.file_stem(F.col("path")).alias("stem"), F.lower(F.hex("image.data")).alias("pixels"))


@query("""SELECT (vec_id // 100)::VARCHAR AS video, count(*) AS frames, 25.0::DOUBLE AS fps, 32 AS width, 32 AS height,
    count(*) FILTER (vec_id % 100 < 11) AS marked FROM embeddings GROUP BY vec_id // 100""")
def tracked_videos(spark, sf_dir):
    """Videos with tracked boxes drawn, written and decoded again: size, and frames on which the first vehicle's box can be seen.

    It moves by three points a frame, so its left edge has left the frames of 32 points from the eleventh on.
    """
    folder = _folder(spark, "tracked")
    pipelines.tracked_videos(_scenes(spark, sf_dir, 32), _watcher(), folder, labels=False)
    seen = frame_files.read_videos(videos.list_videos(spark, folder))
    # blue, green and red of the tenth row at the box's left edge: green but for what coding loses
    place = 3 * (32 * 9 + 3 * F.col("frame_idx")) + 1
    level = lambda k: F.conv(F.hex(F.substring("image.data", (place + k).cast("int"), F.lit(1))), 16, 10).cast("int")
    green = (3 * F.col("frame_idx") < 32) & (level(1) > 128) & (level(0) < 100) & (level(2) < 100)
    shown = seen.select(detections.file_stem(F.col("video_id")).alias("video"), "fps", F.col("image.width").alias("width"), F.col("image.height").alias("height"), green.alias("green"))
    return shown.groupBy("video", "fps", "width", "height").agg(F.count("*").alias("frames"), F.count_if("green").alias("marked"))
