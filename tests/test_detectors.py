"""Suppression, raw detector output, labels, crops before boxes are exploded, and numbering of hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import detections, kernels, lettering, models, suppression
from lumenframe.operators.models import ModelSpec, ScriptedDetector, ScriptedOcr
from lumenframe.plans import pipelines
from lumenframe.schema import IMAGE

BOXES = "image_id int, results array<array<struct<class_id:int,confidence:double,xyxy:array<double>>>>"
NAN = float("nan")


def stayed(spark, boxes, most_iou=0.5, **options):
    boxes = [b and (b[0], b[1], [float(v) for v in b[2]]) for b in boxes]
    df = spark.createDataFrame([(1, [boxes])], BOXES)
    (row,) = suppression.suppress_results(df, most_iou, **options).collect()
    return [tuple(b.xyxy[:1]) + (b.class_id, b.confidence) for b in row.results[0]]


def iou(a, b):
    side = lambda k: max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))
    common = side(0) * side(1)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return common / (area(a) + area(b) - common)


def test_suppression_by_hand(spark):
    one, near, apart = [0.0, 0.0, 10.0, 10.0], [1.0, 0.0, 11.0, 10.0], [2.0, 20.0, 12.0, 30.0]
    assert stayed(spark, [(2, 0.5, near), (2, 0.9, one), (2, 0.1, apart)]) == [(0.0, 2, 0.9), (2.0, 2, 0.1)]
    # another class stays, unless classes are taken together
    assert stayed(spark, [(2, 0.5, near), (3, 0.9, one)]) == [(0.0, 3, 0.9), (1.0, 2, 0.5)]
    assert stayed(spark, [(2, 0.5, near), (3, 0.9, one)], per_class=False) == [(0.0, 3, 0.9)]
    # the first of equals stays; an overlap of the limit itself doesn't suppress
    assert stayed(spark, [(2, 0.5, near), (2, 0.5, one)]) == [(1.0, 2, 0.5)]
    assert len(stayed(spark, [(2, 0.5, near), (2, 0.5, one)], most_iou=iou(one, near))) == 2
    # a suppressed box suppresses none: the third overlaps only the second
    chain = [(2, 0.9, [0.0, 0, 10, 10]), (2, 0.8, [4.0, 0, 14, 10]), (2, 0.7, [8.0, 0, 18, 10])]
    assert [x for x, *_ in stayed(spark, chain, most_iou=0.3)] == [0.0, 8.0]
    assert len(stayed(spark, [(2, 0.1 * k, [20.0 * k, 0, 20.0 * k + 9, 9]) for k in range(9)], most=3)) == 3


def test_suppression_of_odd_boxes(spark):
    one = [0.0, 0.0, 10.0, 10.0]
    got = stayed(spark, [(2, NAN, [1.0, 0.0, 10.0, 10.0]), (2, None, [2.0, 0.0, 10.0, 10.0]), (2, 0.3, one)])
    assert got == [(0.0, 2, 0.3)]  # those of unknown confidence go last
    kept = stayed(spark, [(2, 0.5, [NAN, 0.0, 9.0, 9.0]), (2, 0.9, [5.0, 5.0, 5.0, 5.0]), (2, 0.8, one), (2, 0.7, [3.0]), None])
    assert len(kept) == 4
    df = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [None])], BOXES)
    rows = {r.image_id: r.results for r in suppression.suppress_results(df, 0.5).collect()}
    assert rows == {1: None, 2: [], 3: [[]], 4: [None]}


def test_suppression_equals_greedy_choice(spark):
    rng = np.random.default_rng(3)
    rows = []
    for image in range(40):
        corner = rng.integers(0, 40, (30, 2)).astype(float)
        side = rng.integers(5, 30, (30, 2))
        rows.append((image, [[(int(rng.integers(2)), float(rng.integers(1, 9)) / 10, [*c, *(c + s)]) for c, s in zip(corner.tolist(), side, strict=True)]]))
    rows = [(k, [[(c, f, [float(v) for v in np.ravel([*x[:2], x[2], x[3]])]) for c, f, x in r[0]]]) for k, r in rows]
    got = suppression.suppress_results(spark.createDataFrame(rows, BOXES).repartition(3), 0.4).collect()
    for r in got:
        kept = []
        for b in sorted(rows[r.image_id][1][0], key=lambda b: -b[1]):
            if not any(k[0] == b[0] and iou(k[2], b[2]) > 0.4 for k in kept):
                kept.append(b)
        assert [(b.class_id, b.confidence, b.xyxy) for b in r.results[0]] == kept
    plan = suppression.suppress_results(spark.createDataFrame(rows, BOXES), 0.4)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_raw_output_by_hand():
    output = np.array([[10, 20, 30], [10, 20, 30], [4, 8, 2], [6, 2, 2], [0.2, 0.7, 0.1], [0.9, 0.7, 0.2]])
    assert suppression.decode_raw(output, 2.0, 0.5) == [(1, 0.9, 4.0, 3.5, 6.0, 6.5), (0, 0.7, 8.0, 9.5, 12.0, 10.5)]


def test_onnx_layouts_and_batches(monkeypatch):
    calls = []

    class Session:
        def __init__(self, shape, out):
            self.shape, self.out = shape, out

        def get_inputs(self):
            return [type("Input", (), {"name": "images", "shape": self.shape})]

        def run(self, _, feed):
            calls.append(feed["images"].shape)
            return [np.repeat(self.out[None], len(feed["images"]), 0)]

    onnx = pytest.importorskip("onnxruntime")
    images = [np.zeros((4, 8, 3), np.uint8)] * 20
    rows = np.array([[0, 0, 8, 8, 0.9, 2], [0, 0, 8, 8, 0.1, 2]])
    for shape, sizes in ((["n", 3, 16, 16], [16, 4]), ([1, 3, 16, 16], [1] * 20)):
        calls.clear()
        monkeypatch.setattr(onnx, "InferenceSession", lambda path, providers, shape=shape: Session(shape, rows))
        found = models.OnnxDetector("x", 16, least=0.5).predict(images)
        assert found == [[[(2, 0.9, 0.0, 0.0, 4.0, 4.0)]]] * 20 and [c[0] for c in calls] == sizes
    raw = np.array([[4.0], [4.0], [8.0], [8.0], [0.3], [0.6]])
    monkeypatch.setattr(onnx, "InferenceSession", lambda path, providers: Session(["n", 3, 16, 16], raw))
    assert models.OnnxDetector("x", 16, "raw", 0.5).predict(images[:1]) == [[[(1, 0.6, 0.0, 0.0, 4.0, 4.0)]]]


def test_glyphs_by_hand():
    shown = ["".join("#" if p else "." for p in row) for row in lettering.glyphs("1T-")]
    assert shown == [
        "..#...#####......",
        ".##.....#........",
        "..#.....#........",
        "..#.....#...#####",
        "..#.....#........",
        "..#.....#........",
        ".###....#........",
    ]
    assert lettering.glyphs("").shape == (7, 0) and (lettering.glyphs("a") == lettering.glyphs("A")).all()
    assert (lettering.glyphs("é") == lettering.glyphs("?")).all() and not lettering.glyphs(" ").any()
    assert len(lettering._glyphs()) == 48 and all(g.shape == (7, 5) and g.any() for g in lettering._glyphs().values())


def test_labels_by_hand():
    image = np.full((30, 40, 3), 7, np.uint8)
    drawn = lettering.draw_label(image, [5, 20, 30, 29], "1", (0, 255, 0), (1, 2, 3))
    bar = drawn[11:20, 5:12]
    ink = np.pad(lettering.glyphs("1"), 1)
    assert (bar[ink] == [1, 2, 3]).all() and (bar[~ink] == [0, 255, 0]).all()
    rest = np.ones((30, 40), bool)
    rest[11:20, 5:12] = False
    assert (drawn[rest] == 7).all() and (image == 7).all()
    # no room above: below the edge; beyond the sides: cut off; larger letters
    assert (lettering.draw_label(image, [5, 3, 9, 9], "1")[3, 5] == [0, 255, 0]).all()
    assert (lettering.draw_label(image, [-4, 20, 9, 29], "1")[11:20, :3] != 7).any() and (lettering.draw_label(image, [-4, 20, 9, 29], "1")[:, 3:] == 7).all()
    assert (lettering.draw_label(image, [500, 20, 900, 29], "1") == 7).all() and (lettering.draw_label(image, [5, 200, 9, 300], "1") == 7).all()
    assert (lettering.draw_label(image, [0, 20, 9, 29], "1", size=2)[2:20, 0:14] != 7).all()
    assert lettering.draw_label(image[:, :, :1], [5, 20, 9, 29], "x").shape == (30, 40, 1)


def picture(first, h=60, w=80):
    out = np.full((h, w, 3), 90, np.uint8)
    out[0, 0] = first
    return out


DETECTOR = ModelSpec(ScriptedDetector, ({1: [[(2, 0.9, 10, 20, 30, 40), (7, 0.5, 40, 30, 60, 50)]], 2: [[(2, NAN, 1, 1, 5, 5), (2, 0.4, NAN, 1, 5, 5), (2, 0.3, -9, 1, float("inf"), 5)]]},))
OCR = ModelSpec(ScriptedOcr, ({},))


def image_table(spark, firsts, **size):
    rows = [(k, kernels.to_image(picture(f, **size))) for k, f in enumerate(firsts)]
    return spark.createDataFrame(rows, spark.range(1).schema.add("image", IMAGE))


def test_boxes_are_labelled_and_outlined(spark):
    got = pipelines.annotated_frames(image_table(spark, [1]), DETECTOR).first()
    want = picture(1)
    for box, text in (([10, 20, 30, 40], "car 0.90"), ([40, 30, 60, 50], "truck 0.50")):
        want = lettering.draw_label(kernels.draw_box(want, box), box, text)
    assert (kernels.to_array(got.image.asDict()) == want).all()
    assert (want != kernels.draw_box(kernels.draw_box(picture(1), [10, 20, 30, 40]), [40, 30, 60, 50])).any()


def test_tracks_are_labelled_with_ids(spark):
    frames = image_table(spark, [1, 1, 1]).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_idx"), F.lit(25.0).alias("fps"), "image")
    got = {r.frame_idx: r.image for r in pipelines.annotated_tracks(frames, pipelines.track_boxes(frames, DETECTOR)).collect()}
    want = lettering.draw_label(kernels.draw_box(picture(1), [10, 20, 30, 40]), [10, 20, 30, 40], "id:1 car 0.90")
    assert len(got) == 3 and (kernels.to_array(got[2].asDict()) == want).all()  # the other box is too faint to start a track


def test_images_end_where_boxes_are_cropped(spark):
    """What leaves the detecting stage grows with the crops, not with images times boxes."""
    images = image_table(spark, [1] * 4, h=300, w=400)
    stage = models.detect_crops(images, DETECTOR)
    assert stage.columns == ["id", "crops"]
    sent = sum(len(c.crop.data) for r in stage.collect() for c in r.crops)
    assert sent == 4 * 2 * 20 * 20 * 3 < 300 * 400 * 3
    plan = pipelines.detect_and_read(images, DETECTOR, OCR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan
    export = pipelines.export_best_plates(images, DETECTOR, "id")
    plan = export._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("Scan") == 1
    assert [r.bbox for r in export.collect()] == [[10, 20, 30, 40]] * 4


def test_boxes_that_hold_no_pixel(spark):
    images = image_table(spark, [2, 3])
    read = pipelines.detect_and_read(images, DETECTOR, OCR).collect()
    assert [(r.id, r.pos, list(r.crop_bbox)) for r in read] == [(0, 0, [1, 1, 5, 5])]  # of unknown confidence: kept by the limit
    assert pipelines.export_best_plates(images, DETECTOR, "id").count() == 0
    assert pipelines.detect_and_read(images.limit(0), DETECTOR, OCR).count() == 0


def test_columns_of_other_names_pass_and_of_the_results_are_errors(spark):
    images = image_table(spark, [1])
    other = images.withColumn("rank", F.lit(5)).withColumn("one", F.lit(6)).withColumn("best", F.lit(7)).withColumn("width", F.lit(8)).withColumn("packed", F.lit(9))
    assert pipelines.detect_and_read(other, DETECTOR, OCR).select("rank", "one", "best", "width", "packed").distinct().collect() == [(5, 6, 7, 8, 9)]
    assert pipelines.annotated_frames(other, DETECTOR).select("packed").first()[0] == 9
    assert pipelines.export_best_plates(other.withColumn("bbox", F.lit(1)).withColumn("pos", F.lit(1)), DETECTOR, "id").count() == 1
    assert pipelines.best_plate(other, DETECTOR, "id").select("rank").first()[0] == 5
    for name, run in (("bbox", lambda d: pipelines.detect_and_read(d, DETECTOR, OCR)), ("pos", lambda d: pipelines.detect_plates(d, DETECTOR)), ("results", lambda d: models.detect(d, DETECTOR))):
        with pytest.raises(ValueError, match=name):
            run(images.withColumn(name, F.lit(1)))


def test_a_hot_key_is_numbered_by_many_tasks(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.when(F.col("id") % 20 > 0, F.col("id"))).alias("user"), (F.col("id") * 7919 % 4001).alias("at"), F.lit("x").alias("part"))
    got = detections.number_split(rows, ["user"], ["at"], slices=16)
    assert got.columns == ["user", "at", "part", "n"]
    want = detections.number_rows(rows, ["user"], ["at"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    ranges = rows.repartitionByRange(16, "user", "at").where("user = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges > 8
    assert detections.number_split(rows.limit(0), ["user"], ["at"]).count() == 0
