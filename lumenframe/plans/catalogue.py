"""The operators applied to the driver's tables, each with the SQL that gives the same rows.

Tables stand in for detections: events are frames (event_id the frame, user_id
the track, event_type the class, value the confidence), lineitem rows are boxes
of an image (l_orderkey), embeddings are coordinates or 8 x 8 gray images.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import boxes, display, text
from lumenframe.operators import detections, kernels, suppression
from lumenframe.schema import OCR_DOC, Settings
from lumenframe.streaming import tracking
from lumenframe.workspace import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SETTINGS = Settings()
#: Classes of events, as the vehicle classes are of detections.
EVENT_CLASSES = {"click": "car", "view": "truck"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumnRenamed("event_id", "frame_idx")


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as raw boxes: the first four numbers, a thousandfold, on a 400 x 300 image."""
    coordinates = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 1000)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", coordinates.alias("xyxy"), F.lit(1.0).alias("confidence"), F.lit(400).alias("width"), F.lit(300).alias("height")
    )


_INT_BOX = "SELECT vec_id, " + ", ".join(
    f"cast(trunc(cast(embedding[{k}] AS DOUBLE) * 1000) AS INT) AS {c}" for k, c in enumerate(("x1", "y1", "x2", "y2"), 1)
) + " FROM embeddings"
_CLIPPED = f"""SELECT vec_id, least(greatest(x1, 0), 400) AS x1, least(greatest(y1, 0), 300) AS y1,
    least(greatest(x2, 0), 400) AS x2, least(greatest(y2, 0), 300) AS y2 FROM ({_INT_BOX})"""
_CROPS = f"SELECT * FROM ({_CLIPPED}) WHERE x2 > x1 AND y2 > y1"


def _corners(box: str) -> list:
    return [boxes.corner(F.col(box), k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'truck' END AS class
    FROM events WHERE event_type IN ('click', 'view')""")
def class_filter_label(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(boxes.is_class(F.col("event_type"), EVENT_CLASSES))
    return events.select("event_id", boxes.class_label(F.col("event_type"), EVENT_CLASSES).alias("class"))


@query("SELECT event_id, value FROM events WHERE NOT (value < 25)")
def confidence_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(boxes.confident(F.col("value"), 25.0)).select("event_id", "value")


@query("SELECT event_id AS frame_idx, value FROM events WHERE (event_id + 1) % 10 = 0")
def frame_stride(spark, sf_dir):
    return detections.stride(frames(spark, sf_dir), SETTINGS.stride).select("frame_idx", "value")


@query("SELECT event_id AS frame_idx, event_type FROM events WHERE event_id = 180")
def frame_seek(spark, sf_dir):
    return detections.seek(frames(spark, sf_dir), SETTINGS.seek_frame).select("frame_idx", "event_type")


@query("SELECT event_id AS frame_idx, event_type FROM events WHERE event_id = 0")
def first_frame(spark, sf_dir):
    return detections.first_frames(frames(spark, sf_dir)).select("frame_idx", "event_type")


@query(f"SELECT *, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS bbox FROM ({_INT_BOX})")
def bbox_truncate(spark, sf_dir):
    cast = raw_boxes(spark, sf_dir).withColumn("b", boxes.to_int_box(F.col("xyxy")))
    return cast.select("vec_id", *_corners("b"), F.array_join(F.col("b").cast("array<string>"), ",").alias("bbox"))


@query(_CROPS)
def crop_nonempty(spark, sf_dir):
    return detections.keep_crops(raw_boxes(spark, sf_dir), SETTINGS).select("vec_id", *_corners("bbox"))


@query(f"""SELECT vec_id, greatest(0, x1 - cast(trunc((x2 - x1) * 0.15::DOUBLE) AS INT)) AS x1,
    greatest(0, y1 - cast(trunc((y2 - y1) * 0.25::DOUBLE) AS INT)) AS y1,
    least(400, x2 + cast(trunc((x2 - x1) * 0.15::DOUBLE) AS INT)) AS x2,
    least(300, y2 + cast(trunc((y2 - y1) * 0.25::DOUBLE) AS INT)) AS y2 FROM ({_CROPS})""")
def margin_clamp(spark, sf_dir):
    crops = detections.keep_crops(raw_boxes(spark, sf_dir), SETTINGS)
    wide = boxes.expand_box(F.col("bbox"), F.col("width"), F.col("height"), SETTINGS)
    return crops.withColumn("bbox", wide).select("vec_id", *_corners("bbox"))


@query(f"""SELECT vec_id, CASE WHEN s > 1 THEN cast(trunc(w * s) AS INT) ELSE w END AS width,
    CASE WHEN s > 1 THEN cast(trunc(h * s) AS INT) ELSE h END AS height
    FROM (SELECT *, least(5.0::DOUBLE, 3800.0::DOUBLE / greatest(w, h)) AS s
    FROM (SELECT vec_id, 10 * (x2 - x1) AS w, 10 * (y2 - y1) AS h FROM ({_CROPS})))""")
def resize_plan(spark, sf_dir):
    crops = detections.keep_crops(raw_boxes(spark, sf_dir), SETTINGS).select("vec_id", *_corners("bbox"))
    sized = crops.select("vec_id", (10 * (F.col("x2") - F.col("x1"))).alias("w"), (10 * (F.col("y2") - F.col("y1"))).alias("h"))
    scale = boxes.resize_scale(F.col("w"), F.col("h"), SETTINGS)
    return sized.select("vec_id", boxes.resized_side(F.col("w"), scale).alias("width"), boxes.resized_side(F.col("h"), scale).alias("height"))


_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')"


@query(f"""WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
    pairs AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i, len(x) + doc_id % 3 - 1 AS n FROM lines)
    SELECT doc_id, cast(i - 1 AS INT) AS pos, {_STRIP.format('t')} AS text, i / 100.0::DOUBLE AS score
    FROM pairs WHERE i <= n AND {_STRIP.format('t')} <> ''""")
def ocr_zip_strip(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("texts"))
    n = (F.size("texts") + F.col("doc_id") % 3 - 1).cast("int")
    scores = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i / F.lit(100.0))).otherwise(
        F.array().cast("array<double>")
    )
    pairs = lines.select("doc_id", F.posexplode(text.zip_shortest(F.col("texts"), scores)).alias("pos", "p"))
    return pairs.select("doc_id", "pos", "p.*").where(F.col("text") != "")


@query("""SELECT event_id, coalesce(json_array_length(props, '$.rec_texts'), 0)::INT AS n_texts,
    (props->>'$.k')::INT AS k FROM events""")
def json_default(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    doc = text.parse_doc(F.col("props"))
    return events.select(
        "event_id", F.size(doc.getField("rec_texts")).alias("n_texts"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def row_numbering(spark, sf_dir):
    numbered = detections.number_rows(table(spark, sf_dir, "events"), ["user_id"], ["event_id"])
    return numbered.select("event_id", "user_id", "n")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS frames
    FROM events""")
def running_frames(spark, sf_dir):
    """The running count of frames of a user is its number among them; a busy user's rows spread over tasks."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return detections.number_split(events, ["user_id"], ["event_id"], "frames")


@query("""SELECT hour, string_agg(user_id::VARCHAR, ',' ORDER BY user_id) AS ids, count(*) AS n
    FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS hour, user_id FROM events) GROUP BY hour""")
def frame_id_list(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "user_id").distinct()
    lists = detections.collect_ordered(ids, ["hour"], ["user_id"], ["user_id"], "l")
    joined = F.array_join(F.transform("l", lambda r: r.getField("user_id").cast("string")), ",")
    return lists.select("hour", joined.alias("ids"), F.size("l").cast("long").alias("n"))


@query("""SELECT event_type, count(*) AS frames, count(*) FILTER ((event_id + 1) % 10 = 0) AS checked,
    sum(CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id % 4 + 1 END)::BIGINT AS detections FROM events GROUP BY event_type""")
def frame_totals(spark, sf_dir):
    ids = F.when(F.col("user_id") % 5 != 0, F.sequence(F.lit(0), (F.col("user_id") % 4).cast("int")))
    tracked = frames(spark, sf_dir).withColumn("track_ids", ids)
    return detections.frame_totals(tracked, ["event_type"], "track_ids", SETTINGS.stride)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unannotated(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return detections.unannotated(documents, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def annotated(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return detections.annotated(documents, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def class_dim_join(spark, sf_dir):
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return detections.label_by_join(table(spark, sf_dir, "nation"), region, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("""WITH best AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
    FROM events WHERE event_type = 'purchase' AND value > 250)
    SELECT u.user_id, coalesce('e' || event_id, '') AS text, coalesce(value, 0.0) AS score
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN best b ON u.user_id = b.user_id AND r = 1""")
def ocr_argmax_default(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    high = events.where((F.col("event_type") == "purchase") & (F.col("value") > 250))
    best = detections.best_per_group(high, ["user_id"], "value", ["event_id"])
    found = best.select("user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"), F.col("value").alias("score"))
    return events.select("user_id").distinct().join(found, "user_id", "left").select(
        "user_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
    FROM lineitem WHERE l_discount > 0) WHERE r = 1""")
def best_box(spark, sf_dir):
    best = detections.best_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount", _LINE_ORDER)
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")


@query("""SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ','
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS boxes FROM lineitem GROUP BY l_orderkey""")
def detections_collect(spark, sf_dir):
    lists = detections.collect_ordered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE_ORDER, ["l_linenumber", "l_partkey"], "l")
    item = F.transform("l", lambda r: F.concat_ws(":", r.getField("l_linenumber").cast("string"), r.getField("l_partkey").cast("string")))
    return lists.select("l_orderkey", F.size("l").cast("long").alias("n"), F.array_join(item, ",").alias("boxes"))


@query("""SELECT user_id, true AS has_result, bool_or(CASE WHEN value > 300 THEN event_type ELSE '' END <> '') AS has_text
    FROM events GROUP BY user_id""")
def found_flag(spark, sf_dir):
    read = table(spark, sf_dir, "events").withColumn("text", F.when(F.col("value") > 300, F.col("event_type")).otherwise(""))
    return detections.found_flags(read, ["user_id"], "text")


@query("SELECT event_id, 'Frame ' || printf('%03d', event_id + 1) AS label FROM events")
def frame_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", display.frame_label(F.col("event_id")).alias("label"))


@query("""SELECT vec_id, r * 5 + c AS pos, cast(embedding[(r + 2) * 8 + c + 1 + 1] AS DOUBLE) AS value
    FROM embeddings, range(3) a(r), range(5) b(c)""")
def crop_tile(spark, sf_dir):
    """Rows 2 to 4 and columns 1 to 5 of an 8 x 8 image, by slices of the array."""
    rows = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda r: F.slice("embedding", r * 8 + 2, F.lit(5))))
    tiles = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(rows).alias("pos", "value"))
    return tiles.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query("""SELECT vec_id, p AS pos, cast(floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r + 0.5::DOUBLE) AS INT) AS gray
    FROM (SELECT vec_id, p, cast(floor(abs(cast(embedding[3 * p + 1] AS DOUBLE)) * 400) AS INT) AS b,
    cast(floor(abs(cast(embedding[3 * p + 2] AS DOUBLE)) * 400) AS INT) AS g,
    cast(floor(abs(cast(embedding[3 * p + 3] AS DOUBLE)) * 400) AS INT) AS r FROM embeddings, range(21) t(p))""")
def gray_pixels(spark, sf_dir):
    """Consecutive numbers as blue, green and red; the luma as an expression."""
    channel = lambda p, k: F.floor(F.abs(F.get(F.col("embedding"), 3 * p + k).cast("double")) * 400).cast("int")
    blue, green, red = kernels.LUMA

    def luma(p):
        return F.floor(F.lit(blue) * channel(p, 0) + F.lit(green) * channel(p, 1) + F.lit(red) * channel(p, 2) + F.lit(0.5)).cast("int")

    pixels = F.transform(F.sequence(F.lit(0), F.lit(20)), luma)
    planes = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pixels).alias("pos", "gray"))
    return planes.select("vec_id", F.col("pos").cast("long").alias("pos"), "gray")


def _planes(spark: SparkSession, sf_dir: str, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel over every embedding as an 8 x 8 gray plane: the result's size and pixels."""
    schema = "vec_id long, height int, width int, pixels string"

    def stage(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = run(np.clip(np.abs(np.array(values).reshape(8, 8)) * 400, 0, 255).astype(np.uint8))
                rows.append({"vec_id": key, "height": out.shape[0], "width": out.shape[1], "pixels": out.tobytes().hex()})
            kinds = pa.schema([("vec_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(stage, schema)


_PLANE = "SELECT vec_id, p // 8 AS y, p % 8 AS x, floor(least(abs(embedding[p + 1]::DOUBLE) * 400, 255)) AS v FROM embeddings, range(64) t(p)"


def _cubic_sql(target: str) -> str:
    """Weights (t, s) of the cubic kernel that resamples 8 points to ``target``."""
    return f"""SELECT t, least(greatest(b + k, 0), 7) AS s, sum(CASE WHEN d <= 1 THEN 1.25::DOUBLE * d * d * d - 2.25::DOUBLE * d * d + 1
        WHEN d < 2 THEN -0.75::DOUBLE * (d * d * d - 5 * d * d + 8 * d - 4) ELSE 0 END) AS w
        FROM (SELECT t, b, k, abs(a - (b + k)) AS d FROM (SELECT t, a, floor(a)::INT AS b FROM (SELECT t, (t + 0.5::DOUBLE) * 8 / {target} - 0.5::DOUBLE AS a FROM range({target}) r(t))), range(-1, 3) q(k)) GROUP BY t, s"""


def _resized_sql(width: int, height: int) -> str:
    """The plane resized: (vec_id, y, x, v)."""
    return f"""SELECT vec_id, y, w.t AS x, greatest(0, least(255, floor(round(sum(w.w * v), 6) + 0.5::DOUBLE))) AS v
        FROM (SELECT vec_id, h.t AS y, x, sum(h.w * v) AS v FROM ({_PLANE}) JOIN ({_cubic_sql(str(height))}) h ON h.s = y GROUP BY vec_id, h.t, x)
        JOIN ({_cubic_sql(str(width))}) w ON w.s = x GROUP BY vec_id, y, w.t"""


@query(f"SELECT vec_id, 24 AS height, 24 AS width, string_agg(printf('%02x', v::INT), '' ORDER BY y, x) AS pixels FROM ({_resized_sql(24, 24)}) GROUP BY vec_id")
def resize_cubic(spark, sf_dir):
    """Every plane enlarged three times, compared pixel by pixel."""
    return _planes(spark, sf_dir, lambda p: kernels.resize(p, 24, 24))


#: Adaptive equalisation of 40 x 32 points in tiles of 5 x 4: of 20 points the limit leaves one of each gray, and the rest is dealt to bins in even steps.
_EQUAL = f"""WITH px AS MATERIALIZED ({_resized_sql(40, 32)}),
    tiles AS MATERIALIZED (SELECT *, CASE WHEN rest > 0 THEN greatest(256 // rest, 1) ELSE 1 END AS step FROM (SELECT vec_id, y // 4 AS ty, x // 5 AS tx,
    list(DISTINCT v) AS d, 20 - count(DISTINCT v) AS rest FROM px GROUP BY ALL)),
    near AS (SELECT vec_id, y, x, v, least(greatest(floor(fy)::INT + a, 0), 7) AS ty, least(greatest(floor(fx)::INT + b, 0), 7) AS tx,
    (CASE WHEN a = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN b = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS share
    FROM (SELECT *, (y + 0.5::DOUBLE) / 4 - 0.5::DOUBLE AS fy, (x + 0.5::DOUBLE) / 5 - 0.5::DOUBLE AS fx FROM px), range(2) r(a), range(2) q(b)),
    equal AS (SELECT vec_id, y, x, floor(round(sum(share * floor((len(list_filter(d, lambda u: u <= v)) + least(rest, v::INT // step + 1)) * 255 / 20.0::DOUBLE + 0.5::DOUBLE)), 6)
    + 0.5::DOUBLE)::INT AS v FROM near JOIN tiles USING (vec_id, ty, tx) GROUP BY vec_id, y, x)"""


@query(f"{_EQUAL} SELECT vec_id, 32 AS height, 40 AS width, string_agg(printf('%02x', v), '' ORDER BY y, x) AS pixels FROM equal GROUP BY vec_id")
def clahe_tile(spark, sf_dir):
    """Every plane enlarged and equalised, compared pixel by pixel."""
    return _planes(spark, sf_dir, lambda p: kernels.clahe(kernels.resize(p, 40, 32)))


@query(f"{_EQUAL} SELECT vec_id, 32 AS height, 40 AS width, string_agg(repeat(printf('%02x', v), 3), '' ORDER BY y, x) AS pixels FROM equal GROUP BY vec_id")
def enhanced_plane(spark, sf_dir):
    """The whole chain before OCR on three equal channels: resize, gray, equalise, and back to three channels."""
    return _planes(spark, sf_dir, lambda p: kernels.enhance(kernels.to_bgr(p), 40, 32, SETTINGS.clip_limit, SETTINGS.tiles))


@query("""SELECT vec_id, 3 AS height, 7 AS width, string_agg(printf('%02x', floor(round(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 6) + 0.5::DOUBLE)::INT), '' ORDER BY p) AS pixels
    FROM (SELECT vec_id, p, floor(least(abs(embedding[3 * p + 1]::DOUBLE) * 400, 255)) AS b, floor(least(abs(embedding[3 * p + 2]::DOUBLE) * 400, 255)) AS g,
    floor(least(abs(embedding[3 * p + 3]::DOUBLE) * 400, 255)) AS r FROM embeddings, range(21) t(p)) GROUP BY vec_id""")
def gray_kernel(spark, sf_dir):
    """The luma of 21 coloured points by the kernel that the plans use."""
    return _planes(spark, sf_dir, lambda p: kernels.gray(p.ravel()[:63].reshape(3, 7, 3)))


@query("""WITH crops AS (SELECT *, trunc(l_quantity)::INT AS x1, trunc(l_quantity + l_partkey % 7)::INT AS x2 FROM lineitem
    WHERE NOT (l_discount * 10 < 0.25)), reads AS (SELECT *, CASE
    WHEN l_tax * 10 > 0 AND l_tax >= l_discount AND l_returnflag <> '' THEN l_returnflag
    WHEN l_discount * 10 > 0 AND l_linestatus <> '' THEN l_linestatus ELSE '' END AS text,
    CASE WHEN l_tax * 10 > 0 AND l_tax >= l_discount THEN l_tax * 10 WHEN l_discount * 10 > 0 THEN l_discount * 10 ELSE 0.0 END AS score
    FROM crops WHERE x2 > x1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, text, l_discount * 10 AS detection_confidence,
    score AS ocr_confidence, x1, 0 AS y1, x2, 10 AS y2 FROM reads""")
def detect_and_read(spark, sf_dir):
    """The flagship plan over precomputed boxes and OCR lists: threshold, cast, crop test and the best text of each box.

    A single pass without a shuffle; the choice is a fold within the row.
    """
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    confidence = F.col("l_discount") * 10
    doc = F.struct(
        F.array("l_returnflag", "l_linestatus").alias("rec_texts"), F.array(F.col("l_tax") * 10, confidence).alias("rec_scores")
    ).cast(OCR_DOC)
    found = table(spark, sf_dir, "lineitem").select(
        *key,
        confidence.alias("confidence"),
        F.array(F.col("l_quantity"), F.lit(0.0), F.col("l_quantity") + F.col("l_partkey") % 7, F.lit(10.0)).alias("xyxy"),
        F.lit(1000).alias("width"),
        F.lit(1000).alias("height"),
        F.array(doc).alias("docs"),
    )
    best = detections.keep_crops(found, SETTINGS).withColumn("best", text.best_reading(F.col("docs")))
    return best.select(
        *key, F.col("best.text").alias("text"), F.col("confidence").alias("detection_confidence"), F.col("best.score").alias("ocr_confidence"), *_corners("bbox")
    )


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def track_counts_stream(spark, sf_dir):
    """Counts per track by Structured Streaming over the events file, run to its end."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = "track_counts_stream_result"
    tracking.run_to_end(tracking.running_totals(stream, ["user_id"]), name, scratch(spark, "stream"), "complete")
    return spark.table(name)


@query()
def track_assign(spark, sf_dir):
    """Tracks over embeddings as frames of three boxes, one video for each label."""
    box = lambda k: F.struct(
        F.lit(0.9).alias("confidence"),
        F.array(*[(F.lit(200.0 * k) + F.get("embedding", F.lit(2 * k + a)).cast("double") * 40 + s) for s in (0, 60) for a in (0, 1)]).alias("xyxy"),
    )
    seen = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("frame_idx"), F.array(*[box(k) for k in range(3)]).alias("boxes")
    )
    return tracking.track(seen).select("video_id", "frame_idx", F.array_join(F.col("track_ids").cast("array<string>"), ",").alias("track_ids"))


@query("""WITH b AS (SELECT vec_id, vec_id // 10 AS image_id, x1, y1, x2, y2 FROM (""" + _CROPS + """)), t AS (SELECT * FROM b WHERE vec_id % 2 = 0),
    p AS (SELECT t.image_id, t.vec_id AS object_pos, f.vec_id AS pos,
    greatest(0.0::DOUBLE, least(t.x2, f.x2)::DOUBLE - greatest(t.x1, f.x1)) * greatest(0.0::DOUBLE, least(t.y2, f.y2)::DOUBLE - greatest(t.y1, f.y1)) AS i,
    (t.x2 - t.x1)::DOUBLE * (t.y2 - t.y1) + (f.x2 - f.x1)::DOUBLE * (f.y2 - f.y1) AS s FROM t JOIN b f ON t.image_id = f.image_id AND f.vec_id % 2 = 1),
    best AS (SELECT *, i / (s - i) AS iou, row_number() OVER (PARTITION BY object_pos ORDER BY i / (s - i) DESC, pos) AS r FROM p WHERE i / (s - i) >= 0.1)
    SELECT t.image_id, t.vec_id AS object_pos, pos, round(iou, 9) AS iou FROM t LEFT JOIN best ON object_pos = t.vec_id AND r = 1""")
def truth_match(spark, sf_dir):
    """Boxes of an image matched to true ones by overlap; ten vectors make an image, and every second box is a true one."""
    crops = detections.keep_crops(raw_boxes(spark, sf_dir), SETTINGS).select(F.floor(F.col("vec_id") / 10).alias("image_id"), "vec_id", "bbox")
    truth = crops.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "object_pos")
    found = crops.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "pos")
    matched = detections.match_truth(found, truth, 0.1)
    return matched.select("image_id", "object_pos", "pos", F.round("iou", 9).alias("iou"))


#: Boxes of a vector for suppression: twelve of five numbers, two classes, rounded confidences that tie, some of them NaN.
_OVERLAPS = """SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY isnan(confidence), CASE WHEN isnan(confidence) THEN 0 ELSE -confidence END, j) AS r
    FROM (SELECT vec_id, j::INT AS j, (j % 2)::INT AS class_id, CASE WHEN vec_id % 7 = 0 AND j = 11 THEN 'nan'::DOUBLE ELSE floor(abs(e[5 * j + 5]) * 40) / 10 END AS confidence,
    e[5 * j + 1] * 200 AS x1, e[5 * j + 2] * 200 AS y1, e[5 * j + 1] * 200 + 30 + abs(e[5 * j + 3]) * 100 AS x2, e[5 * j + 2] * 200 + 30 + abs(e[5 * j + 4]) * 100 AS y2
    FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), range(12) t(j))"""
_COMMON = "greatest(0.0::DOUBLE, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0.0::DOUBLE, least(k.y2, b.y2) - greatest(k.y1, b.y1))"


@query(f"""WITH RECURSIVE b AS MATERIALIZED ({_OVERLAPS}), kept AS (
    SELECT vec_id, 0::BIGINT AS r, []::STRUCT(class_id INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, j INT)[] AS l FROM embeddings UNION ALL
    SELECT s.vec_id, b.r, CASE WHEN len(list_filter(s.l, lambda k: k.class_id = b.class_id
    AND {_COMMON} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_COMMON}) > 0.3)) > 0 THEN s.l
    ELSE list_append(s.l, {{'class_id': b.class_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'j': b.j}}) END
    FROM kept s JOIN b ON b.vec_id = s.vec_id AND b.r = s.r + 1)
    SELECT vec_id, array_to_string(list_transform(l, lambda k: k.j), ',') AS stayed FROM kept WHERE r = 12""")
def suppressed_boxes(spark, sf_dir):
    """The numbers of the boxes that suppression within a class leaves, best first; equal and NaN confidences among them."""
    e = lambda j, k: F.get("embedding", F.lit(5 * j + k)).cast("double")
    confidence = lambda j: F.floor(F.abs(e(j, 4)) * 40).cast("double") / 10

    def box(j: int):
        unsure = F.when((F.col("vec_id") % 7 == 0) & F.lit(j == 11), F.lit(float("nan"))).otherwise(confidence(j))
        x, y = e(j, 0) * 200, e(j, 1) * 200
        xyxy = F.array(x, y, x + 30 + F.abs(e(j, 2)) * 100, y + 30 + F.abs(e(j, 3)) * 100, F.lit(float(j)))
        return F.struct(F.lit(j % 2).alias("class_id"), unsure.alias("confidence"), xyxy.alias("xyxy"))

    found = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array(*[box(j) for j in range(12)])).alias("results"))
    stayed = suppression.suppress_results(found, 0.3).select("vec_id", F.flatten("results").alias("boxes"))
    numbers = F.transform("boxes", lambda b: F.get(b.getField("xyxy"), F.lit(4)).cast("int").cast("string"))
    return stayed.select("vec_id", F.array_join(numbers, ",").alias("stayed"))
