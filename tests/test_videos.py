"""AVI files: bytes of the format by hand, segments of many tasks, reading by ranges, and damage."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import kernels
from lumenframe.schema import FRAME
from lumenframe.sources import avi, frames, jpeg, videos


def gray(k, h=16, w=24, channels=3):
    return np.full((h, w, channels), k, np.uint8)


def video_rows(video, many, fps=12.5, **size):
    return [(video, k, fps, kernels.to_image(gray(10 + 2 * k, **size))) for k in range(many)]


def stitched(coded, fps=29.97):
    out = io.BytesIO()
    sizes = [len(c) for c in coded]
    avi.stitch(out, fps, 24, 16, sizes, [io.BytesIO(b"".join(map(avi.frame_chunk, coded[:2]))), io.BytesIO(b"".join(map(avi.frame_chunk, coded[2:])))])
    return out.getvalue()


def test_bytes_by_hand():
    coded = [b"abc", b"defg", b""]
    data = stitched(coded)
    assert data[:4] == b"RIFF" and struct.unpack("<I", data[4:8])[0] == len(data) - 8 and data[8:16] == b"AVI LIST"
    movie = data.index(b"movi")
    assert data[movie + 4 : movie + 36] == b"00dc\3\0\0\0abc\0" + b"00dc\4\0\0\0defg" + b"00dc\0\0\0\0"
    assert struct.unpack("<I", data[movie - 4 : movie])[0] == 4 + 12 + 12 + 8
    entries = data[data.index(b"idx1") + 8 :]
    assert [struct.unpack("<4s3I", entries[k : k + 16])[2:] for k in (0, 16, 32)] == [(4, 3), (16, 4), (28, 0)]
    video = avi.open_video(io.BytesIO(data))
    assert (round(video.fps, 2), video.width, video.height, video.frames) == (29.97, 24, 16, 3)
    assert list(avi.read_frames(io.BytesIO(data), video, 0, 9)) == list(enumerate(coded))
    assert list(avi.read_frames(io.BytesIO(data), video, 1, 3, 2)) == [(1, b"defg")]
    with pytest.raises(avi.AviError):
        avi.header(25.0, 4, 4, [1 << 31, 1 << 31])


def test_damaged_files():
    data = stitched([b"abc", b"defg", b"hij"])
    for bad in (b"", b"RIFFxxxxWAVE", data[:100], data[: data.index(b"idx1")], data.replace(b"MJPG", b"H264"), data.replace(b"strh", b"junk")):
        with pytest.raises(avi.AviError):
            avi.open_video(io.BytesIO(bad))
    cut = data.replace(struct.pack("<4s3I", b"00dc", 0x10, 4, 3), struct.pack("<4s3I", b"00dc", 0x10, 4, 1 << 20))
    with pytest.raises(avi.AviError):
        list(avi.read_frames(io.BytesIO(cut), avi.open_video(io.BytesIO(cut)), 0, 3))


def test_round_trip_in_segments(spark, tmp_path):
    rows = video_rows("a/b c.mov", 20) + video_rows("two", 7, 30.0, h=5, w=9) + video_rows("gray", 3, 1.0, channels=1) + [("two", 50, 30.0, None), ("none", 0, 25.0, None)]
    table = spark.createDataFrame(rows, FRAME).repartition(5)
    folder = f"file://{tmp_path}/out"
    segments = videos.write_segments(table, f"{folder}/s", per_task=4)
    sizes = {(r.video_id, r.part): len(r.sizes) for r in segments.collect()}
    assert sizes == {("a/b c.mov", k): 4 for k in range(5)} | {("two", 0): 4, ("two", 1): 3, ("gray", 0): 3}
    written = {r.video_id: (r.path.rsplit("/", 1)[1], r.frames) for r in videos.write_videos(table, folder).collect()}
    assert written["two"] == ("two.avi", 7) and written["gray"] == ("gray.avi", 3) and set(written) == {"a/b c.mov", "two", "gray"}
    assert written["a/b c.mov"][0].startswith("b_c.mov-") and written["a/b c.mov"][1] == 20
    files = videos.list_videos(spark, folder)
    assert files.count() == 3
    manifest = {r.path.rsplit("/", 1)[1]: (r.fps, r.width, r.height, r.frames) for r in frames.video_manifest(files).collect()}
    assert manifest["two.avi"] == (30.0, 9, 5, 7) and manifest[written["a/b c.mov"][0]] == (12.5, 24, 16, 20)
    got = {(r.video_id.rsplit("/", 1)[1], r.frame_idx): r for r in frames.read_videos(files).collect()}
    assert len(got) == 30
    for video, name in (("a/b c.mov", written["a/b c.mov"][0]), ("two", "two.avi"), ("gray", "gray.avi")):
        for _, k, fps, image in [r for r in rows if r[0] == video and r[3] is not None]:
            want = jpeg.decode_jpeg(jpeg.encode_jpeg(kernels.to_array(image)))
            assert got[name, k].fps == fps and (kernels.to_array(got[name, k].image.asDict()) == want).all()
    assert sorted(r.frame_idx for r in frames.read_videos(files.where("path like '%two.avi'"), stride=3, stop=6).collect()) == [2, 5]


def test_frames_of_one_video_have_one_size(spark, tmp_path):
    rows = video_rows("v", 2) + [("v", 2, 25.0, kernels.to_image(gray(1, 8, 8)))]
    with pytest.raises(Exception, match="different sizes"):
        videos.write_videos(spark.createDataFrame(rows, FRAME), f"file://{tmp_path}/o").collect()


def test_files_that_are_no_videos_and_damaged_frames(spark, tmp_path):
    coded = [jpeg.encode_jpeg(gray(k)) for k in (10, 20, 30)]
    (tmp_path / "bad.avi").write_bytes(stitched([coded[0], coded[1][:40], coded[2]]))
    (tmp_path / "no.avi").write_bytes(b"RIFF")
    files = videos.list_videos(spark, f"file://{tmp_path}")
    more = files.unionAll(spark.createDataFrame([("gone", f"file://{tmp_path}/gone.avi")], "video_id string, path string"))
    assert frames.video_manifest(more).where("fps is null").count() == 2
    got = {r.frame_idx: r.image for r in frames.read_videos(more).collect()}
    assert set(got) == {0, 1, 2} and got[1] is None and got[2] is not None
    assert frames.read_videos(files.limit(0)).count() == 0
    assert videos.write_videos(spark.createDataFrame([], FRAME), f"file://{tmp_path}/o").count() == 0
    assert F is not None
