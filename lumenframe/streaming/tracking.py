"""Multi-object tracking by the two-pass association of ByteTrack (Zhang et al., ECCV 2022).

One step function serves batch and Structured Streaming. A Kalman filter predicts
every track. Confident boxes are matched with confirmed and lost tracks, faint boxes
then with those tracks only that the last frame still saw, and confident boxes that
are left with tentative tracks. What is left of them starts tentative tracks, which
a match in the next frame confirms and its lack ends; in a video's first frame
tracks are confirmed at once. Lost tracks age out. A track gets its id when it is
confirmed; ids count from 1 in each video and belong to that video.

Frames of one video are worked in order by one task, which holds the tracks and
one frame: Spark partitions by video and sorts, and no video is collected.
Frames without boxes still age tracks. Filter classes before this stage, since a
filter after it would change the association. Boxes without area, or with a
coordinate or confidence that is null or NaN, are never tracked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.streaming import motion
from lumenframe.workspace import pieces


@dataclass(frozen=True)
class TrackSettings:
    """Thresholds; the defaults follow the publication's spirit and are no promise of equal ids.

    ``buffer`` is for how many frames a lost track is kept, ``quiet`` after how many
    seconds without frames a stream forgets a video.
    """

    high: float = 0.5
    low: float = 0.1
    start: float = 0.6
    least_iou: float = 0.2
    faint_iou: float = 0.5
    tentative_iou: float = 0.3
    buffer: int = 30
    quiet: float = 3600.0


TENTATIVE, TRACKED, LOST = "tentative", "tracked", "lost"
#: A track as it stands in a stream's state.
TRACK = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("seen", T.LongType()),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("covariance", T.ArrayType(T.DoubleType())),
    ]
)


@dataclass
class Track:
    """A track: id (0 until it is confirmed), status, the last frame that saw it, and its motion."""

    id: int
    status: str
    seen: int
    mean: np.ndarray
    covariance: np.ndarray

    def row(self) -> tuple:
        return self.id, self.status, self.seen, self.mean.tolist(), self.covariance.ravel().tolist()

    @staticmethod
    def of(row) -> Track:
        id_, status, seen, mean, covariance = row
        return Track(int(id_), str(status), int(seen), np.array(list(mean)), np.array(list(covariance)).reshape(8, 8))


@dataclass
class TrackerState:
    """Tracks of one video, the next id and the last frame worked."""

    next_id: int = 1
    last_frame: int = -1
    tracks: list[Track] = field(default_factory=list)


def _ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    common = np.prod(np.maximum(0, high - low), axis=2)
    area = lambda x: np.prod(np.maximum(0, x[:, 2:] - x[:, :2]), axis=1)
    both = area(a)[:, None] + area(b)[None] - common
    return np.where(both > 0, common / np.where(both > 0, both, 1), 0.0)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a minimum-cost assignment of rows to columns, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return [(r, c) for c, r in assign(cost.T)]
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, via, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[column] = True
            reduced = cost[owner[column] - 1] - u[owner[column]] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], via[1:][better] = reduced[better], column
            open_ = np.where(done, np.inf, least)
            open_[0] = np.inf
            target = int(open_.argmin())
            delta = open_[target]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            column = target
            if not owner[column]:
                break
        while column:
            owner[column] = owner[via[column]]
            column = via[column]
    return [(int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c]]


def _predict(state: TrackerState, frames: int) -> None:
    """Every track moved on by so many frames; the height of a lost one stays."""
    if not state.tracks:
        return
    means, covariances = np.stack([t.mean for t in state.tracks]), np.stack([t.covariance for t in state.tracks])
    means[[t.status == LOST for t in state.tracks], 7] = 0.0
    for _ in range(frames):
        means, covariances = motion.predict(means, covariances)
    for t, mean, covariance in zip(state.tracks, means, covariances, strict=True):
        t.mean, t.covariance = mean, covariance


def _match(tracks: list[Track], boxes: np.ndarray, frame_idx: int, least: float) -> tuple[dict[int, Track], list[Track], list[int]]:
    """Tracks by the box that each is matched with and updated by, the tracks left, and the boxes left."""
    if not tracks or not len(boxes):
        return {}, tracks, list(range(len(boxes)))
    overlap = _ious(motion.to_boxes(np.stack([t.mean for t in tracks])), boxes)
    # a pair that must not be is dearer than all others together
    pairs = [(r, c) for r, c in assign(np.where(overlap >= least, 1 - overlap, 1.0 + overlap.size)) if overlap[r, c] >= least]
    if pairs:
        chosen = [tracks[r] for r, _ in pairs]
        measures = motion.to_measure(boxes[[c for _, c in pairs]])
        updated = motion.update(np.stack([t.mean for t in chosen]), np.stack([t.covariance for t in chosen]), measures)
        for t, mean, covariance in zip(chosen, *updated, strict=True):
            t.mean, t.covariance, t.seen, t.status = mean, covariance, frame_idx, TRACKED
    taken, used = {r for r, _ in pairs}, {c for _, c in pairs}
    return {c: tracks[r] for r, c in pairs}, [t for k, t in enumerate(tracks) if k not in taken], [c for c in range(len(boxes)) if c not in used]


def _trackable(confidence: float | None, box: list) -> bool:
    values = [confidence, *box]
    return len(box) == 4 and all(v is not None and math.isfinite(v) for v in values) and box[2] > box[0] and box[3] > box[1]


def step(state: TrackerState, frame_idx: int, boxes: list[tuple[float, list[float]]], settings: TrackSettings) -> list[int | None]:
    """Advance ``state`` by one frame; the id of each box (confidence, xyxy), None if untracked."""
    first, gap = state.last_frame < 0, frame_idx - state.last_frame
    state.last_frame = frame_idx
    state.tracks = [t for t in state.tracks if frame_idx - t.seen <= settings.buffer]
    _predict(state, gap)
    able = [k for k, (c, box) in enumerate(boxes) if _trackable(c, box)]
    confident = [k for k in able if boxes[k][0] >= settings.high]
    faint = [k for k in able if settings.low <= boxes[k][0] < settings.high]
    at = lambda some: np.array([boxes[k][1] for k in some], float).reshape(-1, 4)
    found: dict[int, Track] = {}

    def meet(tracks: list[Track], some: list[int], least: float) -> tuple[list[Track], list[int]]:
        matched, alone, left = _match(tracks, at(some), frame_idx, least)
        found.update({some[c]: t for c, t in matched.items()})
        return alone, [some[c] for c in left]

    tentative = [t for t in state.tracks if t.status == TENTATIVE]
    alone, confident = meet([t for t in state.tracks if t.status != TENTATIVE], confident, settings.least_iou)
    unseen, _ = meet([t for t in alone if t.status == TRACKED], faint, settings.faint_iou)
    for t in unseen:
        t.status = LOST
    ended, confident = meet(tentative, confident, settings.tentative_iou)
    state.tracks = [t for t in state.tracks if not any(t is e for e in ended)]
    fresh = [k for k in confident if boxes[k][0] >= settings.start]
    if fresh:
        for k, mean, covariance in zip(fresh, *motion.start(motion.to_measure(at(fresh))), strict=True):
            found[k] = Track(0, TRACKED if first else TENTATIVE, frame_idx, mean, covariance)
            state.tracks.append(found[k])
    ids: list[int | None] = [None] * len(boxes)
    for k in sorted(found):
        if found[k].status == TRACKED:
            if not found[k].id:
                found[k].id, state.next_id = state.next_id, state.next_id + 1
            ids[k] = found[k].id
    return ids


#: Input: video_id, frame_idx and boxes (null if the model gave none).
FOUND = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("has_boxes", T.BooleanType()),
        T.StructField("track_ids", T.ArrayType(T.IntegerType())),
        T.StructField("box_ids", T.ArrayType(T.IntegerType())),
    ]
)


def _row(state: TrackerState, video: str, frame: int, boxes: list | None, settings: TrackSettings) -> dict:
    given = [(b["confidence"], list(b["xyxy"])) for b in boxes] if boxes is not None else []
    ids = step(state, frame, given, settings)
    tracked = [i for i in ids if i is not None]
    return {"video_id": video, "frame_idx": frame, "has_boxes": boxes is not None, "track_ids": tracked or None, "box_ids": ids}


def track(frames: DataFrame, settings: TrackSettings = TrackSettings()) -> DataFrame:
    """Track ids of every frame, in box order; null where a frame has no tracked box."""
    ordered = frames.select("video_id", "frame_idx", "boxes").repartition("video_id").sortWithinPartitions("video_id", "frame_idx")

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        video, state = None, TrackerState()
        for batch in pieces(batches):
            out = []
            for r in batch.to_pylist():
                if r["video_id"] != video or state.last_frame < 0:
                    video, state = r["video_id"], TrackerState()
                out.append(_row(state, video, r["frame_idx"], r["boxes"], settings))
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(FOUND))

    return ordered.mapInArrow(run, FOUND)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(settings: TrackSettings):
    """The stateful processor of a video: a list of typed tracks, counters, and a timer that forgets a quiet video."""
    from pyspark.sql.streaming import StatefulProcessor

    class VideoTracker(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.tracks = handle.getListState("tracks", TRACK)
            self.counters = handle.getValueState("counters", "next_id int, last_frame long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            state = TrackerState()
            if self.counters.exists():
                state.next_id, state.last_frame = map(int, self.counters.get())
                state.tracks = [Track.of(t) for t in self.tracks.get()]
            given = [r for part in rows for r in part[["frame_idx", "boxes"]].itertuples(index=False)]
            out = []
            for r in sorted(given, key=lambda r: r.frame_idx):
                if r.frame_idx > state.last_frame:
                    boxes = None if r.boxes is None else [b.asDict() if hasattr(b, "asDict") else b for b in r.boxes]
                    out.append(_row(state, key[0], int(r.frame_idx), boxes, settings))
            self.counters.update((state.next_id, state.last_frame))
            self.tracks.put([t.row() for t in state.tracks]) if state.tracks else self.tracks.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(settings.quiet * 1000))
            yield pd.DataFrame(out, columns=FOUND.names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.tracks.clear()
            self.counters.clear()
            return iter(())

        def close(self):
            """Nothing is held beside the state."""

    return VideoTracker()


def track_stream(frames: DataFrame, settings: TrackSettings = TrackSettings()) -> DataFrame:
    """track() over a stream, with the tracks of each video in checkpointed state.

    The frames of a micro-batch are sorted; a frame that isn't after the last
    one worked is rejected, since tracks can't be wound back. A video without
    frames for ``quiet`` seconds is forgotten; later frames of it begin anew. The
    session's state store becomes RocksDB, which typed state needs.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = frames.select("video_id", "frame_idx", "boxes").groupBy("video_id")
    return keyed.transformWithStateInPandas(_processor(settings), FOUND, "append", "processingTime")


def running_totals(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts per key in state, for update or complete mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def run_to_end(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Work what a finite stream source holds, in micro-batches, into Parquet beside the checkpoint, viewed as ``table``.

    Each micro-batch has a folder of its own, so one that is worked again replaces
    its rows. The view has the rows of all batches, or in complete mode the last's.
    """
    spark, rows = stream.sparkSession, f"{checkpoint}-rows"
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{rows}/stream_batch={k}")
    write_each_batch(stream, write, checkpoint, mode).awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(rows)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        done = spark.read.schema(T.StructType([*stream.schema, T.StructField("stream_batch", T.LongType())])).parquet(rows)
        if mode == "complete":
            done = done.where(F.col("stream_batch") == done.agg(F.max("stream_batch")).first()[0])
        done = done.drop("stream_batch")
    else:
        done = spark.createDataFrame([], stream.schema)
    done.createOrReplaceTempView(table)


def write_each_batch(stream: DataFrame, write, checkpoint: str, mode: str = "append"):
    """Call ``write(df, batch_id)`` for every micro-batch of what the source holds; returns the running query.

    Without batches that have no rows: a stream with timers would go on with them
    for ever. Its timers go off with the next rows; in a stream that runs on, by themselves.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        writer = stream.writeStream.foreachBatch(write).outputMode(mode)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
