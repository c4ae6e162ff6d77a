"""Column expressions on edge rows, and against plain Python by property tests."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import boxes, display, text
from lumenframe.operators import detections
from lumenframe.schema import BOX, OCR_DOC, VEHICLE_CLASSES, Settings

S = Settings()
NAN = float("nan")


def one(spark, column, **values):
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("texts", "scores", "want"),
    [
        (["AA00A0000"], [0.8], ("AA00A0000", 0.8)),
        (["A", "B"], [0.9, 0.9], ("A", 0.9)),
        (["A", "B", "C"], [0.1, 0.2], ("B", 0.2)),
        (["  ", " 　\x1c\x85"], [0.99, 0.99], ("", 0.0)),
        (["A", "B"], [NAN, 0.3], ("B", 0.3)),
        (["A"], [0.0], ("", 0.0)),
        (["A"], [-1.0], ("", 0.0)),
        (None, None, ("", 0.0)),
        ([], [], ("", 0.0)),
        ([" A\n"], [0.5], ("A", 0.5)),
        ([None, "B"], [0.9, None], ("", 0.0)),
    ],
)
def test_best_reading(spark, texts, scores, want):
    df = spark.createDataFrame([([{"rec_texts": texts, "rec_scores": scores}],)], f"docs array<{OCR_DOC.simpleString()}>")
    got = df.select(text.best_reading(F.col("docs")).alias("x")).first().x
    assert tuple(got) == want
    assert df.schema["docs"].dataType.elementType == OCR_DOC


def test_best_reading_spans_documents_in_order(spark):
    docs = [{"rec_texts": ["A"], "rec_scores": [0.5]}, {"rec_texts": ["B", "C"], "rec_scores": [0.5, 0.7]}, None]
    df = spark.createDataFrame([(docs,), (None,), ([],)], f"docs array<{OCR_DOC.simpleString()}>")
    assert [tuple(r.x) for r in df.select(text.best_reading(F.col("docs")).alias("x")).collect()] == [("C", 0.7), ("", 0.0), ("", 0.0)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["", " ", "a", "b "]), st.sampled_from([0.0, -1.0, 0.5, 0.7, NAN])), max_size=5), min_size=1, max_size=20))
def test_fold_equals_a_loop(spark, cases):
    def loop(pairs):
        best = ("", 0.0)
        for t, s in pairs:
            if t.strip() and s > best[1]:
                best = (t.strip(), s)
        return best

    df = spark.createDataFrame([(k, [p[0] for p in c], [p[1] for p in c]) for k, c in enumerate(cases)], "k int, t array<string>, s array<double>")
    got = {r.k: tuple(r.x) for r in df.select("k", text.best_pair(text.zip_shortest(F.col("t"), F.col("s"))).alias("x")).collect()}
    assert got == {k: loop(c) for k, c in enumerate(cases)}


def test_strip_equals_python_for_all_white_space(spark):
    import sys

    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    rows = [(c + "a" + c,) for c in [*spaces, "x", "​"]]
    df = spark.createDataFrame(rows, "t string")
    assert [r.x for r in df.select(text.strip(F.col("t")).alias("x")).collect()] == [t.strip() for (t,) in rows]


def test_documents_from_json(spark):
    df = spark.createDataFrame([('{"rec_texts": ["a"]}',), ("{}",), ('{"rec_texts": null, "rec_scores": [1]}',), (None,)], "j string")
    got = [r.d for r in df.select(text.parse_doc(F.col("j")).alias("d")).collect()]
    assert [(d.rec_texts, d.rec_scores) for d in got] == [(["a"], []), ([], []), ([], [1.0]), ([], [])]


FIXTURE = [
    ("i1", 0, 2, 0.90, [1.9, 2.9, 30.1, 20.5]),
    ("i1", 1, 2, 0.25, [5.0, 5.0, 9.0, 9.0]),
    ("i1", 2, 7, 0.2499, [5.0, 5.0, 9.0, 9.0]),
    ("i1", 3, 0, 0.99, [5.0, 5.0, 9.0, 9.0]),
    ("i1", 4, 5, 0.80, [5.2, 5.0, 5.9, 9.0]),
    ("i1", 5, 3, NAN, [1.0, 1.0, 4.0, 4.0]),
    ("i2", 0, 2, 0.70, [-3.7, 2.0, 30.0, 20.0]),
    ("i2", 1, 2, 0.70, [1.0, 2.0, 30.0, 20.0]),
]


@pytest.fixture
def found(spark):
    df = spark.createDataFrame(FIXTURE, "image_id string, pos int, class_id int, confidence double, xyxy array<double>")
    return df.withColumns({"width": F.lit(100), "height": F.lit(80)})


def test_crops_and_classes(found):
    crops = {(r.image_id, r.pos): r.bbox for r in detections.keep_crops(found, S).collect()}
    assert crops == {
        ("i1", 0): [1, 2, 30, 20], ("i1", 1): [5, 5, 9, 9], ("i1", 3): [5, 5, 9, 9], ("i1", 5): [1, 1, 4, 4],
        ("i2", 0): [0, 2, 30, 20], ("i2", 1): [1, 2, 30, 20],
    }
    labelled = detections.keep_classes(found, S).where("image_id = 'i1'")
    assert {r.pos: r["class"] for r in labelled.collect()} == {0: "car", 1: "car", 2: "truck", 4: "bus", 5: "motorcycle"}


def test_truncation_is_toward_zero(found):
    box = found.where("image_id = 'i2' and pos = 0").select(boxes.to_int_box(F.col("xyxy")).alias("b")).first().b
    assert box == [-3, 2, 30, 20]


def test_best_box_numbering_and_collection(found, spark):
    best = detections.best_per_group(found, ["image_id"], "confidence", ["pos"]).collect()
    assert {(r.image_id, r.pos) for r in best} == {("i1", 3), ("i2", 0)}
    assert detections.best_per_group(found.where("isnan(confidence)"), ["image_id"], "confidence", ["pos"]).count() == 0
    numbers = detections.number_rows(found, ["image_id"], ["pos"]).collect()
    assert all(r.n == r.pos + 1 for r in numbers)
    lists = detections.collect_ordered(found.repartition(3), ["image_id"], ["pos"], ["class_id"], "l").collect()
    assert {r.image_id: [x.class_id for x in r.l] for r in lists} == {"i1": [2, 2, 7, 0, 5, 3], "i2": [2, 2]}


@pytest.mark.parametrize(
    ("box", "want"), [([10, 10, 50, 30], [4, 5, 56, 35]), ([2, 1, 98, 79], [0, 0, 100, 80])]
)
def test_margins(spark, box, want):
    b = F.array(*map(F.lit, box))
    assert one(spark, boxes.expand_box(b, F.lit(100), F.lit(80), S)) == want


@pytest.mark.parametrize(
    ("w", "h", "want"), [(100, 40, (500, 200)), (760, 100, (3800, 500)), (3800, 100, (3800, 100)), (4000, 100, (4000, 100)), (1000, 900, (3800, 3420))]
)
def test_resize(spark, w, h, want):
    scale = boxes.resize_scale(F.lit(w), F.lit(h), S)
    row = spark.range(1).select(boxes.resized_side(F.lit(w), scale).alias("a"), boxes.resized_side(F.lit(h), scale).alias("b")).first()
    assert tuple(row) == want


def test_iou_bounds_and_symmetry(spark):
    rows = [([0, 0, 10, 10], [5, 5, 15, 15]), ([0, 0, 10, 10], [0, 0, 10, 10]), ([0, 0, 1, 1], [2, 2, 3, 3]), ([1, 1, 1, 1], [1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    got = df.select(boxes.iou(F.col("a"), F.col("b")).alias("x"), boxes.iou(F.col("b"), F.col("a")).alias("y")).collect()
    assert [r.x for r in got] == [pytest.approx(25 / 175), 1.0, 0.0, 0.0] and all(r.x == r.y for r in got)


def test_display(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.9,), (None,)], "v double")
    assert [r.x for r in df.select(display.two_places("v").alias("x")).collect()] == ["0.12", "2.67", "0.90", None]
    assert one(spark, display.frame_label(F.lit(1233))) == "Frame 1234"
    assert one(spark, display.padded(F.lit(7))) == "007"


def test_flatten_keeps_emission_order(spark):
    results = [[{"class_id": 2, "confidence": 0.5, "xyxy": [0.0] * 4}], [], [{"class_id": 7, "confidence": 0.6, "xyxy": [1.0] * 4}] * 2]
    df = spark.createDataFrame([("a", results, 1), ("b", [], 2)], f"id string, results array<array<{BOX.simpleString()}>>, pos int")
    got = detections.flatten_results(df).collect()
    assert [(r.id, r.pos, r.class_id) for r in got] == [("a", 0, 2), ("a", 1, 7), ("a", 2, 7)]


def test_frames_and_totals(spark):
    rows = [(k, None if k == 3 else [1, 2] if k % 2 else []) for k in range(25)]
    df = spark.createDataFrame(rows, "frame_idx long, ids array<int>").withColumn("video", F.lit("v"))
    assert [r.frame_idx for r in detections.stride(df, 10).collect()] == [9, 19]
    assert [r.frame_idx for r in detections.seek(df, 18).collect()] == [18]
    total = detections.frame_totals(df, ["video"], "ids", 10).first()
    assert (total.frames, total.checked, total.detections) == (25, 2, 22)
    assert total.checked == 25 // 10


def test_small_pieces(spark):
    assert one(spark, boxes.class_ids(VEHICLE_CLASSES)) == list(VEHICLE_CLASSES)
    assert one(spark, boxes.first_item(F.array(F.lit(4.5)))) == 4.5
    assert one(spark, boxes.corner(F.array(F.lit(1)), 3)) is None
    assert one(spark, detections.file_stem(F.lit("file:/a.b/image_0001.tar.jpg"))) == "image_0001.tar"
    assert one(spark, boxes.confident(F.lit(NAN), 0.25)) is True
    assert math.isclose(S.min_confidence, 0.25)
    flags = detections.found_flags(spark.createDataFrame([(1, ""), (1, None), (2, "x")], "g int, t string"), ["g"], "t").collect()
    assert {r.g: (r.has_result, r.has_text) for r in flags} == {1: (True, False), 2: (True, True)}


def test_truth_match(spark):
    truth = spark.createDataFrame([("i", 0, [0, 0, 10, 10]), ("i", 1, [50, 50, 60, 60]), ("j", 0, [0, 0, 5, 5])], "image_id string, object_pos int, bbox array<int>")
    seen = spark.createDataFrame([("i", 0, [1, 1, 10, 10]), ("i", 1, [0, 0, 10, 9]), ("j", 0, [4, 4, 9, 9])], "image_id string, pos int, bbox array<int>")
    got = {(r.image_id, r.object_pos): r.pos for r in detections.match_truth(seen, truth, 0.5).collect()}
    assert got == {("i", 0): 1, ("i", 1): None, ("j", 0): None}
