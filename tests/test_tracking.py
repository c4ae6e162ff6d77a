"""The tracker: assignment, association, and equal results in batch and stream."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.streaming import motion, tracking
from lumenframe.streaming.tracking import TrackerState, TrackSettings, step

BOXES = "video_id string, frame_idx long, boxes array<struct<confidence:double,xyxy:array<double>>>"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, random):
    cost = np.array([[random.choice([0.0, 0.1, 0.5, 1.0, random.random()]) for _ in range(m)] for _ in range(n)])
    got = tracking.assign(cost)
    assert len(got) == min(n, m) == len({r for r, _ in got}) == len({c for _, c in got})
    small, large = (cost, range(m)) if n <= m else (cost.T, range(n))
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(large, min(n, m)))
    assert abs(sum(cost[r, c] for r, c in got) - best) < 1e-9


def moving(frame, x0, speed, y=0.0, confidence=0.9):
    x = float(x0 + speed * frame)
    return (confidence, [x, y, x + 20.0, y + 20.0])


def test_ids_survive_crossings_gaps_and_faint_frames():
    state, seen = TrackerState(), []
    for k in range(30):
        boxes = [moving(k, 0, 4), moving(k, 116, -4, 8.0)]
        if 10 <= k < 13:
            boxes = boxes[:1]  # the second is hidden
        if k == 20:
            boxes[0] = (0.2, boxes[0][1])  # faint, matched in the second pass
        seen.append(step(state, k, boxes, TrackSettings()))
    assert seen[0] == [1, 2] and seen[-1] == [1, 2] and seen[20] == [1, 2]


def test_faint_boxes_start_nothing_and_lost_tracks_age_out():
    state = TrackerState()
    assert step(state, 0, [(0.3, [0, 0, 9, 9])], TrackSettings()) == [None]
    assert step(state, 1, [(0.9, [0, 0, 9, 9])], TrackSettings()) == [None]
    assert step(state, 2, [(0.9, [0, 0, 9, 9])], TrackSettings()) == [1]
    for k in range(3, 40):
        step(state, k, [], TrackSettings())
        assert [t.status for t in state.tracks] == ([tracking.LOST] if k <= 32 else [])
    assert step(state, 40, [(0.9, [0, 0, 9, 9])], TrackSettings()) == [None]
    assert step(state, 41, [(0.9, [0, 0, 9, 9])], TrackSettings()) == [2]


def test_a_tentative_track_ends_without_a_second_look():
    state = TrackerState()
    step(state, 0, [], TrackSettings())
    assert step(state, 1, [(0.9, [0, 0, 9, 9])], TrackSettings()) == [None]
    assert [t.status for t in state.tracks] == [tracking.TENTATIVE]
    step(state, 2, [], TrackSettings())
    assert state.tracks == []


def test_faint_boxes_meet_recently_seen_tracks_only():
    still = [0.0, 0.0, 20.0, 20.0]
    state = TrackerState()
    assert step(state, 0, [(0.9, still)], TrackSettings()) == [1]
    assert step(state, 1, [(0.2, still)], TrackSettings()) == [1]
    assert step(state, 2, [], TrackSettings()) == []
    assert step(state, 3, [(0.2, still)], TrackSettings()) == [None]  # lost by now
    assert step(state, 4, [(0.9, still)], TrackSettings()) == [1]


def test_occlusion_is_bridged_by_the_predicted_motion():
    """Hidden for ten frames, the box comes back 80 pixels on, where only its predicted place overlaps it."""
    state = TrackerState()
    for k in range(40):
        ids = step(state, k, [] if 15 <= k < 25 else [moving(k, 0, 8)], TrackSettings())
        assert ids in ([], [1])
    stays = TrackerState()
    for k in range(15):
        step(stays, k, [moving(0, 0, 8)], TrackSettings())
    assert step(stays, 25, [moving(10, 0, 8)], TrackSettings()) == [None]  # a still box isn't expected there


def test_boxes_that_cannot_be_tracked():
    odd = [(0.9, [0, 0, 0, 9]), (0.9, [5, 5, 1, 9]), (0.9, [float("nan"), 0, 9, 9]), (float("nan"), [0, 0, 9, 9]), (None, [0, 0, 9, 9]), (0.9, [0, 0, 9])]
    assert step(TrackerState(), 0, odd, TrackSettings()) == [None] * 6


def test_motion_by_hand():
    """A box of height 20: one start, one prediction and one correction of its centre, by the scalar formulas."""
    measure = motion.to_measure(np.array([[0.0, 10.0, 10.0, 30.0]]))
    assert measure.tolist() == [[5.0, 20.0, 0.5, 20.0]] and motion.to_boxes(measure).tolist() == [[0.0, 10.0, 10.0, 30.0]]
    mean, cov = motion.start(measure)
    place, speed = (2 * 20 / 20) ** 2, (10 * 20 / 160) ** 2
    assert mean[0].tolist() == [5.0, 20.0, 0.5, 20.0, 0, 0, 0, 0]
    assert np.allclose(np.diag(cov[0]), [place, place, 1e-4, place, speed, speed, 1e-10, speed])
    mean, cov = motion.predict(mean, cov)
    place, speed, both = place + speed + 1.0, speed + (20 / 160) ** 2, speed
    assert np.allclose([cov[0, 0, 0], cov[0, 4, 4], cov[0, 0, 4]], [place, speed, both])
    mean, cov = motion.update(mean, cov, np.array([[9.0, 20.0, 0.5, 20.0]]))
    noise = 1.0
    assert np.allclose(mean[0, [0, 4]], [5 + 4 * place / (place + noise), 4 * both / (place + noise)])
    assert np.allclose(cov[0, 0, 0], place - place**2 / (place + noise)) and np.allclose(cov[0, 4, 4], speed - both**2 / (place + noise))
    assert np.allclose(mean[0, [1, 2, 3]], [20.0, 0.5, 20.0])


def test_speed_is_learned():
    mean, cov = motion.start(motion.to_measure(np.array([[0.0, 0.0, 20.0, 20.0]])))
    for k in range(1, 60):
        mean, cov = motion.update(*motion.predict(mean, cov), motion.to_measure(np.array([[3.0 * k, 0.0, 3.0 * k + 20, 20.0]])))
    assert np.allclose(mean[0, 4:], [3, 0, 0, 0], atol=0.01) and np.allclose(mean[0, 0], 10 + 3 * 59, atol=0.05)


def test_tracks_survive_as_rows():
    state = TrackerState()
    for k in range(3):
        step(state, k, [moving(k, 0, 4)], TrackSettings())
    again = tracking.Track.of(state.tracks[0].row())
    assert again.row() == state.tracks[0].row()


def rows():
    out = []
    for v in ("a", "b"):
        for k in range(24):
            if k == 5:
                out.append((v, k, None))
            else:
                boxes = [moving(k, 0, 3), moving(k, 300, -3, 5.0 if v == "a" else 50.0)]
                out.append((v, k, [] if k == 6 else [{"confidence": c, "xyxy": b} for c, b in boxes]))
    return out


def key(r):
    return r.video_id, r.frame_idx, r.has_boxes, tuple(r.track_ids or ())


def test_batch_equals_the_step_function(spark):
    df = spark.createDataFrame(rows(), BOXES).repartition(5)
    got = {(r.video_id, r.frame_idx): r for r in tracking.track(df).collect()}
    assert len(got) == 48
    for v in ("a", "b"):
        state = TrackerState()
        for _, k, boxes in [r for r in rows() if r[0] == v]:
            ids = step(state, k, [(b["confidence"], b["xyxy"]) for b in boxes or []], TrackSettings())
            assert got[v, k].track_ids == ([i for i in ids if i] or None)
            assert got[v, k].has_boxes == (boxes is not None)


def test_stream_equals_batch_for_a_split_into_micro_batches(spark, tmp_path):
    df = spark.createDataFrame(rows(), BOXES)
    for part, (low, high) in enumerate([(0, 7), (7, 8), (8, 24)]):
        df.where(f"frame_idx >= {low} and frame_idx < {high}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    tracking.run_to_end(tracking.track_stream(stream), "tracked_stream", str(tmp_path / "ck"))
    want = sorted(map(key, tracking.track(df).collect()))
    assert sorted(map(key, spark.table("tracked_stream").collect())) == want


def test_a_restart_from_the_checkpoint_goes_on_with_the_same_ids(spark, tmp_path):
    df = spark.createDataFrame(rows(), BOXES)
    stream = lambda: tracking.track_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")))
    for part, (low, high) in enumerate([(0, 9), (9, 24)]):
        df.where(f"frame_idx >= {low} and frame_idx < {high}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        tracking.run_to_end(stream(), "restarted", str(tmp_path / "ck"))  # a new query each time
    assert sorted(map(key, spark.table("restarted").collect())) == sorted(map(key, tracking.track(df).collect()))


def test_a_quiet_video_is_forgotten(spark, tmp_path):
    import time

    df = spark.createDataFrame(rows(), BOXES)
    quiet = TrackSettings(quiet=0.1)
    stream = lambda: tracking.track_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")), quiet)

    def known():
        state = spark.read.format("statestore").option("stateVarName", "counters").load(str(tmp_path / "ck"))
        return sorted(r[0] for r in state.selectExpr("key.video_id").collect())

    for part, rule in enumerate(("video_id = 'a' and frame_idx < 9", "video_id = 'b' and frame_idx < 9", "video_id = 'a' and frame_idx >= 9")):
        df.where(rule).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        tracking.run_to_end(stream(), "quiet", str(tmp_path / "ck"))
        assert known() == ["a", "b", "a"][part : part + 1]
        time.sleep(0.5)
    late = {r.frame_idx: r.track_ids for r in spark.table("quiet").where("video_id = 'a' and frame_idx >= 9").collect()}
    assert late[9] == [1, 2]  # anew


def test_batches_reach_a_writer(spark, tmp_path):
    df = spark.createDataFrame(rows(), BOXES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = []
    tracking.write_each_batch(stream, lambda batch, _: counts.append(batch.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(counts) == 48


def test_running_totals_are_kept_in_files(spark, tmp_path):
    df = spark.createDataFrame([(k % 5, k) for k in range(40)], "user_id int, k int")
    for part in range(3):
        df.where(f"k % 3 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):  # again without new rows
        tracking.run_to_end(tracking.running_totals(stream, ["user_id"]), "totals", str(tmp_path / "ck"), "complete")
        got = spark.table("totals")
        assert sorted(map(tuple, got.collect())) == [(u, 8) for u in range(5)]
        assert got.inputFiles()  # a memory sink has none
    assert len(list((tmp_path / "ck-rows").glob("stream_batch=*"))) == 3


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("user_id int").parquet(str(tmp_path / "none"))
    tracking.run_to_end(tracking.running_totals(stream, ["user_id"]), "no_totals", str(tmp_path / "ck"), "complete")
    assert spark.table("no_totals").count() == 0
