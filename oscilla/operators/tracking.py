"""Association of per-frame detections to tracks, and choice of the main track.

Only the order-dependent part - which detection continues which track - runs in Python, once per
stretch of a recording.  Rotation, ranking, gap filling and appearance are windows and aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.config import DEFAULTS, Settings
from oscilla.operators import geometry as G
from oscilla.operators.borders import across, running
from oscilla.operators.cohort import null_safe_join
from oscilla.operators.ordering import running_sum, slice_by_order
from oscilla.operators.sequence import nearest_tracked, wrap_to_pi
from oscilla.session import durable


class Tracker:
    """Constant-velocity tracks of one recording, advanced frame by frame."""

    def __init__(self, fps: float, expected: str | None, settings: Settings = DEFAULTS):
        scale = max(1.0, fps) / settings.base_fps
        self.max_gap = max(1, round(settings.max_gap * scale))
        self.jump = settings.max_jump_per_frame / scale
        self.gate = settings.match_thresh
        self.penalty = settings.handedness_penalty
        self.expected = expected
        # one row per track: x, y, vx, vy, last frame; the first ones may be forgotten
        self.state = np.zeros((0, 5))
        self.gone = 0

    def _start(self, frame: int, xy: np.ndarray) -> int:
        self.state = np.vstack([self.state, [xy[0], xy[1], 0.0, 0.0, frame]])
        return len(self.state) - 1

    def forget(self, frame: int) -> None:
        """Drop the leading tracks that no later frame can continue; numbers stay as they are."""
        alive = frame - self.state[:, 4] < self.max_gap
        drop = int(np.argmax(alive)) if alive.any() else len(alive)
        self.state, self.gone = self.state[drop:], self.gone + drop

    def step(self, frame: int, xy: np.ndarray, labels: Sequence[str | None]) -> list[int]:
        """Track number of each detection of this frame."""
        assigned = [-1] * len(xy)
        active = np.flatnonzero(frame - self.state[:, 4] <= self.max_gap)
        if len(active) and len(xy):
            age = frame - self.state[active, 4]
            predicted = self.state[active, :2] + self.state[active, 2:4] * age[:, None]
            dist = np.hypot(*(predicted[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
            limit = np.maximum(self.gate, self.jump * np.maximum(age, 1))
            allowed = dist <= limit[:, None]
            if self.expected is not None:
                other = np.array([v is not None and v != self.expected for v in labels])
                dist = np.where(other[None, :], dist * self.penalty, dist)
            # greedy by distance; equal distances keep track order, then detection order
            for flat in np.argsort(np.where(allowed, dist, np.inf), axis=None, kind="stable"):
                t, d = divmod(int(flat), len(xy))
                if not allowed[t, d]:
                    continue
                allowed[t, :] = allowed[:, d] = False
                row = self.state[active[t]]
                dt = max(1.0, frame - row[4])
                velocity = (xy[d] - row[:2]) / dt
                self.state[active[t]] = [*xy[d], *velocity, frame]
                assigned[d] = int(active[t])
        for d, track in enumerate(assigned):
            if track < 0:
                assigned[d] = self._start(frame, xy[d])
        return [self.gone + t for t in assigned]


def associate(
    detections: DataFrame,
    fps: float,
    expected: str | None = None,
    keys: Sequence[str] = ("video",),
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add ``track`` to detections (keys, frame_idx, det_idx, label, lm, ...).

    After more than ``max_gap`` frames without a detection no track is alive, so recordings are cut
    there: stretches are independent, and the tracks of one are numbered on from those before it.  The
    detections of a stretch pass through one task as a sorted stream, which holds a batch and the tracks
    that may still go on, however long the stretch is.
    """
    keys = list(keys)
    wrist = G.point(F.col("lm"), G.WRIST)
    slim = detections.select(*keys, "frame_idx", "det_idx", "label", wrist["x"].alias("x"), wrist["y"].alias("y"))
    placed = slice_by_order(slim.withColumn("_o", F.struct("frame_idx", "det_idx")), keys, ["_o"])
    dead = Tracker(fps, expected, settings).max_gap

    def begun(rows: DataFrame, by: list[str]) -> DataFrame:
        before = F.lag("frame_idx").over(Window.partitionBy(*by).orderBy("_o"))
        return rows.withColumn("_fresh", F.coalesce(F.col("frame_idx") - before > dead, F.lit(True)).cast("long"))

    cut = running(across(placed, keys, "_o", begun, before=1), keys, "_o", {"stretch": "_fresh"})
    types = dict(detections.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "frame_idx", "det_idx"]) + ", stretch long, track long"
    by = [*keys, "stretch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, last, held = Tracker(fps, expected, settings), None, None
        for batch in chain(batches, [None]):
            # the last frame of a batch may go on in the next
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            edges = _edges(rows, [*by, "frame_idx"])
            ready = len(rows) if batch is None else edges[-2]
            tracks: list[int] = []
            for a, b in pairwise(e for e in edges if e <= ready):
                stretch = tuple(None if pd.isna(v) else v for v in rows.iloc[a][by])
                if stretch != last:
                    tracker, last = Tracker(fps, expected, settings), stretch
                labels = [None if pd.isna(v) else v for v in rows["label"].iloc[a:b]]
                frame = int(rows["frame_idx"].iloc[a])
                tracks += tracker.step(frame, rows[["x", "y"]].iloc[a:b].to_numpy(float), labels)
                tracker.forget(frame)
            held = rows.iloc[ready:]
            if tracks:
                yield rows.iloc[:ready][[*keys, "frame_idx", "det_idx", "stretch"]].assign(track=tracks)

    ordered = cut.select(*by, "frame_idx", "det_idx", "label", "x", "y").repartition(*by).sortWithinPartitions(*by, "frame_idx", "det_idx")
    local = durable(ordered.mapInPandas(run, schema))
    sizes = local.groupBy(*by).agg((F.max("track") + 1).alias("_tracks"))
    numbered = running_sum(sizes, keys, ["stretch"], {"_upto": "_tracks"})
    offsets = numbered.select(*by, (F.col("_upto") - F.col("_tracks")).alias("_before"))
    # the offsets of the stretches after the first; most recordings have one stretch only
    later = offsets.filter("_before > 0")
    assigned = null_safe_join(local, later, by, "left").select(
        *keys, "frame_idx", "det_idx", (F.col("track") + F.coalesce("_before", F.lit(0))).cast("int").alias("track")
    )
    return null_safe_join(detections, assigned, [*keys, "frame_idx", "det_idx"])


def _edges(rows: pd.DataFrame, by: Sequence[str]) -> list[int]:
    """Where runs of equal rows begin, and the end."""
    changed = np.zeros(len(rows), bool)
    for c in by:
        v = rows[c].to_numpy()
        changed[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
    return [0, *np.flatnonzero(changed).tolist(), len(rows)]


def rotation(tracked: DataFrame, keys: Sequence[str] = ("video", "track")) -> DataFrame:
    """Rotation totals of each track from the wrapped steps of its palm roll."""
    order = Window.partitionBy(*keys).orderBy("frame_idx")
    rolled = G.roll_angle(tracked)
    steps = rolled.withColumn("_d", wrap_to_pi(F.col("roll") - F.lag("roll").over(order)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    paths = steps.withColumn("_path", F.coalesce(F.sum("_d").over(upto), F.lit(0.0)))
    mode = F.max_by(F.col("label"), F.struct(F.col("_lc"), -F.col("_lf")))
    labels = (
        tracked.filter(F.col("label").isNotNull())
        .groupBy(*keys, "label")
        .agg(F.count(F.lit(1)).alias("_lc"), F.min("frame_idx").alias("_lf"))
        .groupBy(*keys)
        .agg(mode.alias("hand_label"))
    )
    totals = paths.groupBy(*keys).agg(
        F.coalesce(F.sum(F.abs("_d")), F.lit(0.0)).alias("rot_total"),
        (F.greatest(F.max("_path"), F.lit(0.0)) - F.least(F.min("_path"), F.lit(0.0))).alias("rot_amp"),
        F.count(F.lit(1)).alias("det_count"),
        F.avg("score").alias("avg_conf"),
    )
    return totals.join(labels, list(keys), "left")


def main_track(
    rotations: DataFrame,
    fps: float,
    use_confidence: bool = False,
    keys: Sequence[str] = ("video",),
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The track that rotates most, among those that rotate enough per detection."""
    floor = settings.rot_avg_thresh / (max(1.0, fps) / settings.base_fps)
    average = F.col("rot_total") / F.greatest(F.col("det_count"), F.lit(1))
    conf = F.col("avg_conf") if use_confidence else F.lit(0.0)
    rank = F.struct("rot_total", "rot_amp", "det_count", conf.alias("conf"), (-F.col("track")).alias("t"))
    best = F.max_by(F.struct("track", "rot_total", "rot_amp", "det_count", "hand_label"), rank)
    return (
        rotations.withColumn("avg_rot_per_frame", average)
        .filter(F.col("avg_rot_per_frame") >= floor)
        .groupBy(*keys)
        .agg(best.alias("b"), F.max_by("avg_rot_per_frame", rank).alias("avg_rot_per_frame"))
        .select(*keys, "b.*", "avg_rot_per_frame")
    )


def fill_gaps(
    track: DataFrame,
    spare: DataFrame,
    fps: float,
    expected: str | None = None,
    keys: Sequence[str] = ("video",),
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Frames missing from a track, filled from a second detection pass.

    The candidate nearest to the wrist of the nearest tracked frame is taken when it lies within
    the fill distance; a candidate of the other hand counts as farther.
    """
    keys = list(keys)
    wrist = G.point(F.col("lm"), G.WRIST)
    have = track.select(
        *keys, "frame_idx", F.struct(wrist["x"].alias("x"), wrist["y"].alias("y")).alias("ref"), F.lit(True).alias("_t")
    )
    # only frames that the second pass saw can be filled; they fit between the tracked ones
    asked = spare.select(*keys, "frame_idx").distinct()
    line = asked.join(have, [*keys, "frame_idx"], "full_outer").withColumn(
        "_t", F.coalesce("_t", F.lit(False))
    )
    near = nearest_tracked(line, F.col("_t"), ["ref"], keys)
    open_frames = near.filter(~F.col("_t")).select(*keys, "frame_idx", F.col("nearest.ref").alias("_ref"))
    pairs = spare.join(open_frames.filter(F.col("_ref").isNotNull()), [*keys, "frame_idx"])
    dx, dy = wrist["x"] - F.col("_ref.x"), wrist["y"] - F.col("_ref.y")
    other = F.lit(False) if expected is None else F.coalesce(F.col("label") != expected, F.lit(False))
    dist = F.sqrt(dx * dx + dy * dy) * F.when(other, settings.handedness_penalty).otherwise(1.0)
    best = pairs.withColumn("fill_dist", dist).groupBy(*keys, "frame_idx").agg(
        F.min_by(F.struct("det_idx", "label", "score", "lm", "fill_dist"), F.struct("fill_dist", "det_idx")).alias("b")
    )
    limit = settings.fill_max_dist * settings.base_fps / max(1.0, fps)
    return best.select(*keys, "frame_idx", "b.*").filter(F.col("fill_dist") <= limit)


def appearance(
    track: DataFrame, total_frames: Column, conf: str = "score", keys: Sequence[str] = ("video",)
) -> DataFrame:
    """Detection share within the track's own window and within the recording, with confidence."""
    first, last = F.min("frame_idx"), F.max("frame_idx")
    n = F.count(F.lit(1))
    return track.groupBy(*keys).agg(
        first.alias("first_frame"),
        last.alias("last_frame"),
        n.alias("detected_total"),
        (last - first + 1).alias("window_len"),
        (100.0 * n / (last - first + 1)).alias("adjusted_pct"),
        (100.0 * n / F.nullif(F.max(total_frames), F.lit(0))).alias("non_adjusted_pct"),
        F.sum(conf).alias("conf_sum"),
        F.avg(conf).alias("avg_conf"),
    )
