"""Geometry and tracking on constructed hands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.operators import geometry as G
from oscilla.operators import tracking as TR

LM = "array<struct<x:double,y:double,z:double,v:double>>"


def hand(x, y, roll=0.0, v=1.0):
    """Wrist at (x, y); knuckles on a line turned by ``roll``, the middle one leaving their plane.

    Palm roll is measured inside the hand, so a flat hand has none however it is turned.
    """
    pts = [(x, y, 0.0, v)] * 21
    for k, i in enumerate((5, 9, 13, 17)):
        off = (k - 1.5) * 0.04
        arch = 0.05 * roll if i == 9 else 0.0
        pts[i] = (x + off * np.cos(roll), y + 0.2, off * np.sin(roll) + arch, v)
    return [tuple(map(float, p)) for p in pts]


@pytest.fixture(scope="module")
def crossing(spark):
    """Two hands that cross; only the second one rotates.  Frame 20 loses the still hand."""
    rows = []
    for f in range(60):
        a = hand(0.2 + 0.01 * f, 0.3)
        b = hand(0.8 - 0.01 * f, 0.5, 0.8 * np.sin(f / 3))
        dets = [("Left", a), ("Right", b)] if f % 2 else [("Right", b), ("Left", a)]
        if f == 20:
            dets = [d for d in dets if d[0] == "Right"]
        rows += [(1, f, i, label, 0.9, lm) for i, (label, lm) in enumerate(dets)]
    return spark.createDataFrame(rows, f"video long, frame_idx long, det_idx long, label string, score double, lm {LM}")


def test_association_follows_hands_through_the_crossing(spark, crossing):
    tracked = TR.associate(crossing, 25.0)
    pure = tracked.groupBy("track").agg(F.countDistinct("label").alias("n"))
    assert pure.count() == 2 and pure.filter("n > 1").count() == 0


def test_main_track_is_the_rotating_hand(spark, crossing):
    tracked = TR.associate(crossing, 25.0)
    best = TR.main_track(TR.rotation(tracked), 25.0).first()
    assert best["hand_label"] == "Right" and best["det_count"] == 60


def test_stale_tracks_do_not_continue(spark):
    rows = [(1, f, 0, "Left", 0.5, hand(0.5, 0.5)) for f in (0, 1, 2, 9)]
    df = spark.createDataFrame(rows, f"video long, frame_idx long, det_idx long, label string, score double, lm {LM}")
    assert TR.associate(df, 25.0).select("track").distinct().count() == 2


def test_gap_fill_takes_the_near_detection(spark, crossing):
    track = crossing.filter("label = 'Left' and frame_idx % 5 <> 2")
    filled = TR.fill_gaps(track, crossing, 25.0, "Left")
    assert filled.filter("label <> 'Left'").count() == 0
    assert sorted(r[0] for r in filled.select("frame_idx").collect()) == list(range(2, 60, 5))


def test_visibility_gate_and_overwrite(spark):
    rows = [(1, f, hand(0.5, 0.5, v=0.1 if f == 3 else 0.9)) for f in range(20)]
    df = spark.createDataFrame(rows, f"video long, frame_idx long, lm {LM}")
    kept = G.gate_by_visibility(df)
    assert kept.count() == 19
    refined = df.limit(0).withColumn("conf", F.lit(0.9))
    assert G.overwrite_landmarks(df, refined, 0.3).filter("refined").count() == 0


def test_accepted_frames_leave_edges_and_jitter_out(spark):
    rng = np.random.default_rng(0)
    rows = []
    for f in range(30):
        h = hand(0.5, 0.4)
        h = [(x + rng.normal(0, 1e-4), y + rng.normal(0, 1e-4), z, v) for x, y, z, v in h]
        h[1] = (0.3, 0.2, 0.0, 1.0)
        if f == 7:
            h[5] = (h[5][0] + 0.05, h[5][1], 0.0, 1.0)
        if f == 12:
            h[2] = (0.999, 0.4, 0.0, 1.0)
        rows.append((1, f, h))
    df = spark.createDataFrame(rows, f"video long, frame_idx long, lm {LM}")
    kept = {r[0] for r in G.accept_frames(df).select("frame_idx").collect()}
    assert 7 not in kept and 12 not in kept and len(kept) > 15


def test_pca_angle_is_free_of_axis_choice(spark):
    rows = [(1, f, hand(0.5, 0.5, 0.6 * np.sin(f / 4))) for f in range(40)]
    df = spark.createDataFrame(rows, f"video long, frame_idx long, lm {LM}")
    assert G.pca_angle(df).filter("angle is null or isnan(angle)").count() == 0
    short = df.filter("frame_idx < 9")
    a = {r["frame_idx"]: r["angle"] for r in G.pca_angle(short).collect()}
    b = {r["frame_idx"]: r["k"] for r in short.select("frame_idx", G.knuckle_angle(F.col("lm")).alias("k")).collect()}
    assert a == pytest.approx(b)


def test_degenerate_hands(spark):
    flat = [tuple([0.5, 0.5, 0.0, 1.0])] * 21
    df = spark.createDataFrame([(1, 0, flat)], f"video long, frame_idx long, lm {LM}")
    assert G.roll_angle(df).first()["roll"] is None
    row = df.select(G.refinement_box(F.col("lm"), 640, 480).alias("a"), G.redetection_box(F.col("lm")).alias("b")).first()
    assert row["a"] is None and row["b"] is not None


def test_expected_confidence(spark):
    cats = F.array(
        F.struct(F.lit("Left").alias("label"), F.lit(0.9).alias("score")),
        F.struct(F.lit("Right").alias("label"), F.lit(0.4).alias("score")),
    )
    row = spark.range(1).select(
        G.expected_confidence(cats, "Right").alias("a"), G.expected_confidence(cats, None).alias("b"),
        G.expected_confidence(F.slice(cats, 1, 0), "Left").alias("c"),
    ).first()
    assert tuple(row) == (0.4, 0.9, 0.0)
