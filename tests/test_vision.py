"""Kernels, model stages, sources, sinks and plans with scripted models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import kernels, models
from lumenframe.operators.models import ModelSpec, ScriptedDetector, ScriptedOcr
from lumenframe.plans import pipelines
from lumenframe.schema import IMAGE, Settings
from lumenframe.sources import frames as frame_source
from lumenframe.sources import images as image_source
from lumenframe.sources import sinks, voc


def picture(first, h=80, w=100):
    out = np.full((h, w, 3), 90, np.uint8)
    out[0, 0] = first
    return out


def image_table(spark, arrays):
    return spark.createDataFrame([(k, None if a is None else kernels.to_image(a)) for k, a in arrays], spark.range(1).selectExpr("'' as image_id").schema.add("image", IMAGE))


DETECTOR = ModelSpec(
    ScriptedDetector,
    (
        {
            1: [[(2, 0.9, 1.9, 2.9, 30.1, 20.5), (0, 0.99, 5, 5, 9, 9)], [(7, 0.2, 0, 0, 9, 9), (5, 0.8, 5.2, 5, 5.9, 9)]],
            2: [[(2, 0.7, -3.7, 2, 30, 20), (2, 0.7, 1, 2, 30, 20)]],
        },
    ),
)
OCR = ModelSpec(ScriptedOcr, ({g: [{"rec_texts": [" AB1 ", "CD2"], "rec_scores": [0.6, 0.6]}] for g in range(200)},))


@pytest.fixture
def images(spark):
    return image_table(spark, [("i1", picture(1)), ("i2", picture(2)), ("i3", picture(3)), ("bad", None)])


def test_kernels_by_hand():
    ramp = np.tile(np.arange(0, 80, 10, np.uint8)[None, :, None], (8, 1, 3))
    assert kernels.resize(ramp, 8, 8).tolist() == ramp.tolist()
    assert (kernels.resize(np.full((5, 7, 3), 33, np.uint8), 21, 15) == 33).all()
    assert (np.diff(kernels.resize(ramp, 32, 8)[0, 4:-4, 0].astype(int)) >= 0).all()
    # two points to four: weights of the cubic kernel at -0.25 and 0.25 with replicated borders
    w = kernels._cubic_matrix(2, 4)
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w, w[::-1, ::-1])
    near, far = (1.25 * 0.25**3 - 2.25 * 0.25**2 + 1), (1.25 * 0.75**3 - 2.25 * 0.75**2 + 1)
    out_left, out_right = -0.75 * (1.25**3 - 5 * 1.25**2 + 8 * 1.25 - 4), -0.75 * (1.75**3 - 5 * 1.75**2 + 8 * 1.75 - 4)
    assert np.allclose(w[1], [near + out_left, far + out_right])
    assert kernels.gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [10, 20, 30]]], np.uint8)).tolist() == [[29, 150, 76, 22]]
    assert kernels.crop(picture(1), [-5, 70, 20, 500]).shape == (10, 20, 3)
    assert kernels.to_bgr(np.ones((2, 3), np.uint8)).shape == (2, 3, 3)
    drawn = kernels.draw_box(np.zeros((10, 10, 3), np.uint8), [2, 3, 7, 9], (9, 8, 7), 1)
    assert (drawn[3, 2:7] == [9, 8, 7]).all() and (drawn[4, 3:6] == 0).all() and (drawn.any(axis=2).sum()) == 2 * 5 + 2 * 4
    image = kernels.to_image(picture(4))
    assert (kernels.to_array(image) == picture(4)).all()


def test_clahe_spreads_contrast_and_keeps_constants_flat():
    flat = kernels.clahe(np.full((64, 64), 100, np.uint8))
    assert len(np.unique(flat)) == 1
    rng = np.random.default_rng(0)
    dull = rng.integers(100, 130, (64, 72)).astype(np.uint8)
    out = kernels.clahe(dull, 8.0)
    assert out.std() > 2 * dull.std() and out.shape == dull.shape
    assert kernels.clahe(np.array([[7]], np.uint8)).shape == (1, 1)


def test_vehicles_and_plates(images):
    cars = pipelines.detect_vehicles(images.where("image is not null"), DETECTOR).collect()
    assert {(r.image_id, r["class"], tuple(r.bbox)) for r in cars} == {
        ("i1", "car", (1, 2, 30, 20)), ("i1", "truck", (0, 0, 9, 9)), ("i1", "bus", (5, 5, 5, 9)),
        ("i2", "car", (-3, 2, 30, 20)), ("i2", "car", (1, 2, 30, 20)),
    }
    assert pipelines.detect_plates(images, DETECTOR).count() == 6
    assert pipelines.detect_plates(images, DETECTOR, least=0.25).count() == 5


def test_detect_and_read(images):
    for variable in (True, False):
        got = pipelines.detect_and_read(images, DETECTOR, OCR, variable_scale=variable).collect()
        assert {(r.image_id, r.text, r.detection_confidence, r.ocr_confidence, tuple(r.bbox)) for r in got} == {
            ("i1", "AB1", 0.9, 0.6, (1, 2, 30, 20)), ("i1", "AB1", 0.99, 0.6, (5, 5, 9, 9)),
            ("i2", "AB1", 0.7, 0.6, (-3, 2, 30, 20)), ("i2", "AB1", 0.7, 0.6, (1, 2, 30, 20)),
        }
        assert {tuple(r.crop_bbox) for r in got if r.image_id == "i2"} == {(0, 2, 30, 20), (1, 2, 30, 20)}
    silent = pipelines.detect_and_read(images, DETECTOR, ModelSpec(ScriptedOcr, ({},)), Settings(min_confidence=0.95)).collect()
    assert [(r.text, r.ocr_confidence) for r in silent] == [("", 0.0)]


def test_best_plate_and_export(images, tmp_path):
    best = {r.image_id: (r.pos, r.confidence) for r in pipelines.best_plate(images, DETECTOR, "image_id").collect()}
    assert best == {"i1": (1, 0.99), "i2": (0, 0.7)}
    out = pipelines.export_best_plates(images, DETECTOR, "image_id", margins=True, scale=8.0)
    assert {r.image_id: (r.image.width, r.image.height) for r in out.collect()} == {"i1": (32, 48), "i2": (34 * 8, 24 * 8)}
    written = sinks.write_images(out, f"file://{tmp_path}/crops", "image_id").collect()
    assert len(written) == 2 and all((tmp_path / "crops" / f"{r.name}.ppm").stat().st_size == r.bytes for r in written)


def test_image_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {n: rng.integers(0, 255, (3, 5, c)).astype(np.uint8) for n, c in (("a.ppm", 3), ("b.ppm", 1))}
    for n, a in arrays.items():
        (tmp_path / n).write_bytes(image_source.encode_pnm(a))
    (tmp_path / "c.ppm").write_bytes(b"not an image")
    got = {r.path.rsplit("/", 1)[1]: r.image for r in image_source.read_images(spark, str(tmp_path), glob="*.ppm").collect()}
    assert got["c.ppm"] is None
    assert all((kernels.to_array(got[n].asDict()) == a).all() for n, a in arrays.items())
    counts = image_source.unreadable_count(image_source.read_images(spark, str(tmp_path))).first()
    assert tuple(counts) == (3, 1)
    assert image_source.readable(image_source.read_images(spark, str(tmp_path))).count() == 2


def test_whole_image_reading(images):
    got = pipelines.read_whole(images, OCR, "image_id").collect()
    row = next(r for r in got if r.image_id == "i1")
    assert row.has_result and [(t.text, t.score) for t in row.texts] == [("AB1", 0.6), ("CD2", 0.6)] and "rec_texts" in row.raw
    none = pipelines.read_whole(images, ModelSpec(ScriptedOcr, ({},)), "image_id").where("image_id = 'i1'").first()
    assert not none.has_result and none.texts == []


@pytest.fixture
def video(tmp_path):
    path = tmp_path / "v.npy"
    np.save(path, np.stack([picture(1 + k % 2, 20, 30) for k in range(25)]))
    return str(path)


def test_filters_of_one_query_do_not_reach_another(spark, video):
    frames = frame_source.read_frames(spark, [video])
    assert (frames.where("frame_idx = 18").count(), frames.count()) == (1, 25)
    both = frames.where("frame_idx = 1").unionAll(frames.where("frame_idx = 2"))
    assert sorted(r.frame_idx for r in both.collect()) == [1, 2]


def test_frame_source_reads_ranges_and_strides(spark, video):
    frames = frame_source.read_frames(spark, [video])
    assert frames.count() == 25
    assert [r.frame_idx for r in frames.where("frame_idx = 18").collect()] == [18]
    assert sorted(r.frame_idx for r in frames.where("frame_idx >= 3 and frame_idx < 6 and frame_idx % 2 = 1").select("frame_idx").collect()) == [3, 5]
    meta = frame_source.video_metadata(frames).first()
    assert (meta.fps, meta.width, meta.height) == (25.0, 30, 20)
    assert frame_source.read_frames(spark, ["/nowhere.npy"]).count() == 0
    strided = frame_source.read_frames(spark, [video], stride=4)
    assert sorted(r.frame_idx for r in strided.collect()) == [3, 7, 11, 15, 19, 23]
    ranged = frame_source.read_frames(spark, [video], stride=4, start=8, stop=19)
    assert sorted(r.frame_idx for r in ranged.collect()) == [11, 15]
    assert [r.frame_idx for r in frame_source.read_frames(spark, [video], start=18, stop=19).collect()] == [18]
    assert frame_source.read_frames(spark, [video], start=40).count() == 0
    plain = {r.frame_idx: r.image.data for r in frames.collect()}
    assert all(r.image.data == plain[r.frame_idx] for r in strided.collect())


def test_stride_reads_only_its_frames(spark, tmp_path):
    video = str(tmp_path / "long.npy")
    np.save(video, np.zeros((1000, 2, 2, 3), np.uint8))
    seen = []

    class Counting(frame_source.NpyVideo):
        def read(self, *args):
            for frame in super().read(*args):
                seen.append(1)
                yield frame

    files = spark.createDataFrame([(video, video)], "video_id string, path string")
    dealt = frame_source.ranges(frame_source.video_manifest(files), 10, per_task=16).orderBy("first").collect()
    assert [(r.first, r.last) for r in dealt] == [(k, min(k + 160, 1000)) for k in range(9, 1000, 160)]
    assert [k for r in dealt for k, _ in frame_source.decoded(r.asDict(), 10, Counting())] == list(range(9, 1000, 10)) and len(seen) == 100
    one = frame_source.ranges(frame_source.video_manifest(files), start=18, stop=19).collect()
    assert [(r.first, r.last) for r in one] == [(18, 19)]


def test_many_videos_are_planned_by_tasks(spark):
    import os

    driver = os.getpid()

    class Remote:
        def open(self, path):
            assert os.getpid() != driver
            return 25.0, 4, 4, int(path) % 3 * 300

        def read(self, path, start, stop, step):
            assert os.getpid() != driver
            yield from (np.zeros((1, 1, 1), np.uint8) for _ in range(start, stop, step))

    files = spark.range(10_000).selectExpr("cast(id as string) as video_id", "cast(id as string) as path")
    dealt = frame_source.ranges(frame_source.video_manifest(files, Remote()))
    assert dealt.count() == 3333 * 2 + 3333 * 3
    some = frame_source.read_videos(files.where("video_id < 30"), Remote(), stride=100)
    assert some.count() == 10 * 3 + 10 * 6


def test_video_plans(spark, video, tmp_path):
    frames = frame_source.read_frames(spark, [video])
    strided = pipelines.strided_plates(frames.select("video_id", "frame_idx", "image"), DETECTOR)
    assert {r.frame_idx for r in strided.collect()} == {9, 19}
    tracked = pipelines.track_vehicles(frames, DETECTOR)
    report = pipelines.tracking_report(tracked).first()
    assert (report.frames, report.checked) == (25, 2) and report.detections > 25 and report.tracks >= 1
    drawn = pipelines.annotated_frames(frames, DETECTOR)
    seen = []

    def encode(path, fps, pictures):
        np.save(path, np.stack(list(pictures)))

    out = sinks.write_videos(drawn, str(tmp_path / "out"), encode)
    (tmp_path / "out").mkdir()
    seen = out.collect()
    assert [r.frames for r in seen] == [25]
    stored = np.load(tmp_path / "out" / "v.npy")
    assert stored.shape == (25, 20, 30, 3) and (stored[0] != picture(1, 20, 30)).any()


def test_voc_annotations(spark, tmp_path):
    obj = "<object><name>number_plate</name><truncated>0</truncated><occluded>0</occluded><difficult>0</difficult><bndbox><xmin>{0}</xmin><ymin>2.0</ymin><xmax>30.5</xmax><ymax>40.0</ymax></bndbox><attributes>{1}</attributes></object>"
    attr = lambda n, v: f"<attribute><name>{n}</name><value>{v}</value></attribute>"
    doc = "<annotation><folder>f</folder><filename>{0}.jpg</filename><source><database>d</database><annotation>x</annotation><image>y</image></source><size><width>100</width><height>80</height><depth></depth></size><segmented>0</segmented>{1}</annotation>"
    rotation = attr("rotation", "0.0")
    (tmp_path / "a.xml").write_text(doc.format("a", obj.format("1.5", rotation)))
    (tmp_path / "b.xml").write_text(doc.format("b", "".join(obj.format(str(float(k)), attr("number_plate_text", f"T{k // 2}") + rotation) for k in range(6))))
    rows = voc.read_annotations(spark, str(tmp_path))
    assert rows.count() == 2 and rows.select("size.depth").distinct().collect()[0][0] is None
    objects = voc.plate_texts(voc.annotation_objects(rows)).orderBy("filename", "object_pos").collect()
    assert [(r.filename, r.object_pos, r.xmin, r.text) for r in objects] == [("a.jpg", 0, 1.5, None), *[("b.jpg", k, float(k), f"T{k // 2}") for k in range(6)]]
    assert objects[1].attrs == {"number_plate_text": "T0", "rotation": "0.0"}


def test_json_and_report_lines(spark, images, tmp_path):
    from lumenframe.operators import detections

    cars = detections.number_rows(pipelines.detect_vehicles(images.where("image is not null"), DETECTOR), ["image_id"], ["pos"])
    lines = [r.line for r in sinks.detection_lines(cars.where("image_id = 'i1'").orderBy("n")).collect()]
    assert lines[0] == "1. car 0.90 (1, 2, 30, 20)"
    sinks.write_json(cars, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    ids = spark.createDataFrame([(1234, [1, 2])], "frame_idx long, track_ids array<int>")
    assert sinks.frame_lines(ids).first().line == "Frame 1235 | 2"


def test_properties_of_documents():
    assert models._document(lambda: {"rec_texts": ["a"]}) == {"rec_texts": ["a"], "rec_scores": []}


def test_lookup_and_semi_joins(spark):
    from lumenframe.operators import detections

    images = spark.createDataFrame([("a",), ("b",)], "stem string")
    notes = spark.createDataFrame([("a", 1), ("a", 2)], "stem string, n int")
    assert [r.stem for r in detections.annotated(images, notes, "stem").collect()] == ["a"]
    assert [r.stem for r in detections.unannotated(images, notes, "stem").collect()] == ["b"]
    assert F is not None


def test_rows_of_one_split_are_dealt_to_all_cores(spark, tmp_path):
    """Rows of one input split become images in several tasks, whatever adaptive execution would join."""
    from lumenframe.plans import scripted

    spark.range(0, 400, 1, 1).select(F.col("id").alias("vec_id")).write.parquet(str(tmp_path / "embeddings.parquet"))
    made = scripted.images(spark, str(tmp_path)).select("vec_id", F.spark_partition_id().alias("part"))
    assert made.select("part").distinct().count() >= spark.sparkContext.defaultParallelism
    assert made.count() == 400


def test_texts_as_files(spark, tmp_path):
    from lumenframe.sources import sinks

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "ö\n")], "k long, t string")
    told = sinks.write_texts(rows, f"file://{tmp_path}/t", "k", "t", ".xml").collect()
    assert sorted((r.name, r.bytes) for r in told) == [("1", 1), ("3", 3)]
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "t").iterdir()) == [("1.xml", b"a"), ("3.xml", "ö\n".encode())]


def test_a_stage_holds_few_images_at_once(spark):
    """A batch of Arrow rows is worked in pieces; the model tells by the class how many images it was given."""
    from lumenframe.operators import models

    class Counting:
        def predict(self, images):
            return [[[(len(images), 0.9, 0.0, 0.0, 1.0, 1.0)]] for _ in images]

    image = F.struct(F.lit(1).alias("height"), F.lit(1).alias("width"), F.lit(1).alias("n_channels"), F.unhex(F.lit("00")).alias("data"))
    rows = spark.range(0, 1000, 1, 1).select("id", image.alias("image"))
    found = models.detect(rows, models.ModelSpec(Counting)).select("id", F.col("results")[0][0]["class_id"].alias("n")).collect()
    assert sorted(r.id for r in found) == list(range(1000))
    assert max(r.n for r in found) <= models.PIECE_ROWS
