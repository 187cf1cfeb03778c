"""Recordings cut into slices give what whole recordings give, also where one holds most of the rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oscilla.functions import dsp
from oscilla.operators import borders as B
from oscilla.operators import filters, matching
from oscilla.operators import ordering as O
from oscilla.operators import sequence as S
from oscilla.operators import tracking as TR

KEYS = ["video", "clip"]
FPS = 25.0


@pytest.fixture(scope="module")
def recordings(spark):
    """One long recording, two short ones, one of a single sample, and one without any valid sample."""
    rng = np.random.default_rng(11)
    rows = []
    for video, n in ((1, 700), (2, 40), (None, 60), (4, 1), (5, 30)):
        x = np.cumsum(rng.normal(size=n)) * 2
        lost = rng.random(n) < 0.3
        if video == 1:
            lost[200:420] = True  # longer than a slice
        if video == 5:
            lost[:] = True
        rows += [(video, 0, i, float(v), None if gone else float(v)) for i, (v, gone) in enumerate(zip(x, lost))]
    return spark.createDataFrame(rows, "video long, clip long, frame_idx long, value double, seen double")


def cut(df, slices=23):
    return O.slice_by_order(df, KEYS, ["frame_idx"], slices)


def table(df, *columns):
    rows = df.select(*KEYS, *columns).toPandas()
    return rows.sort_values([*KEYS, "frame_idx"] if "frame_idx" in columns else list(rows.columns), ignore_index=True)


STEPS = {
    "interpolate": lambda df: S.interpolate_gaps(df, "seen", "y"),
    "hampel": lambda df: S.hampel(df, "value", "y"),
    "average": lambda df: S.moving_average(df, ["value"], 5).withColumnRenamed("value_smooth", "y"),
    "average of what is seen": lambda df: S.moving_average(df.filter("seen IS NOT NULL"), ["value"], 3).withColumnRenamed("value_smooth", "y"),
    "one euro": lambda df: S.one_euro(df, "seen", "y", FPS),
    "spikes": lambda df: S.reject_spikes(df.withColumn("angle", S.wrap_to_pi(F.col("seen"))), "angle", "y", FPS),
    "unwrap": lambda df: S.unwrap(df.withColumn("angle", S.wrap_to_pi(F.col("seen"))), "angle", "y"),
    "axial": lambda df: S.unwrap(df.withColumn("angle", S.wrap_to_pi(F.col("seen"))), "angle", "y", axial=True),
    "gradient": lambda df: S.gradient(df, "value", "y", FPS),
    "vertex": lambda df: S.parabolic_vertex(df, "value", "y"),
    "nearest": lambda df: S.nearest_tracked(df, F.col("seen").isNotNull(), ["value"]).withColumn("y", F.col("nearest.value")),
}


@pytest.mark.parametrize("name", STEPS)
def test_windows_across_slices(spark, recordings, name):
    whole, sliced = (table(STEPS[name](df), "frame_idx", "y") for df in (recordings, cut(recordings)))
    pd.testing.assert_frame_equal(whole, sliced)
    assert len(whole) and (name == "spikes" or whole["y"].notna().any())


def test_extrema_across_slices(spark, recordings):
    def crossings(df):
        return S.zero_crossing_extrema(df.withColumn("c", F.col("value") - 3), "value", "c", 1, 10_000)

    whole, sliced = (table(crossings(df), "etype", "frame_idx", "height") for df in (recordings, cut(recordings)))
    pd.testing.assert_frame_equal(whole, sliced)
    runs = spark.createDataFrame([(1, 0, i, 1 if (i // 7) % 2 else -1, float(i * 37 % 11)) for i in range(300)], "video long, clip long, frame_idx long, etype int, height double")
    whole, sliced = (table(S.alternate(df), "frame_idx", "etype", "height") for df in (runs, cut(runs)))
    pd.testing.assert_frame_equal(whole, sliced)
    areas = [S.integral_amplitude(S.gradient(df, "value", "rate", FPS), recordings.filter("frame_idx % 9 = 4"), "rate", FPS) for df in (recordings, cut(recordings))]
    got = [{r["video"]: r["integral_amplitude"] for r in a.collect()} for a in areas]
    assert got[0] == pytest.approx(got[1]) and len(got[0]) >= 2


def test_sums_and_gaps_across_slices(spark, recordings):
    gaps = [S.occlusion_gaps(df, F.col("seen").isNotNull(), FPS).orderBy("video").toPandas() for df in (recordings, cut(recordings))]
    pd.testing.assert_frame_equal(*gaps)
    assert gaps[0]["longest_gap_frames"].max() >= 220
    timed = recordings.select(*KEYS, F.col("frame_idx").alias("cycle_no"), (F.abs("value") + 0.1).alias("interval_s"), F.abs("value").alias("amplitude"), F.abs("value").alias("peak_velocity"))
    sliced = O.slice_by_order(timed, KEYS, ["cycle_no"], 19)
    for build in (S.cycle_features, lambda df: S.interruptions(df, "interval_s")):
        whole, parts = (build(df).orderBy("video").toPandas() for df in (timed, sliced))
        pd.testing.assert_frame_equal(whole, parts[whole.columns], check_exact=False)


def test_border_rows_are_few(spark, recordings):
    sliced = cut(recordings)
    bordered = B.with_borders(sliced, KEYS, "frame_idx", before=2, after=2, near=F.col("seen").isNotNull())
    slices = sliced.select(O.SLICE).distinct().count()
    assert slices >= 15
    assert bordered.filter(~F.col(B.OWN)).count() <= 6 * 2 * slices
    assert bordered.filter(B.OWN).count() == recordings.count()


def test_distances_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    det, man = np.sort(rng.random(300) * 100).round(2), np.sort(rng.random(200) * 100).round(2)
    rows = [(1, 0, float(t), side) for side, ts in (("det", det), ("man", man)) for t in ts] + [(2, 0, 1.0, "man")]
    got = {r["video"]: r for r in matching.set_distances(spark.createDataFrame(rows, "video long, clip long, t double, side string"), KEYS).collect()}
    d, m = np.abs(det[:, None] - man).min(1), np.abs(man[:, None] - det).min(1)
    assert got[1]["nn_det_to_man"] == pytest.approx(d.mean()) and got[1]["nn_man_to_det"] == pytest.approx(m.mean())
    assert got[1]["hausdorff"] == pytest.approx(max(d.max(), m.max()))
    grid = np.sort(np.concatenate([det, man]))
    share = np.abs(np.searchsorted(det, grid, "right") / len(det) - np.searchsorted(man, grid, "right") / len(man))
    assert got[1]["wasserstein"] == pytest.approx((share[:-1] * np.diff(grid)).sum())
    assert got[2]["wasserstein"] == 1.0 and got[2]["hausdorff"] is None


# zero-phase filter

EDGES = dsp.band_edges(FPS, 2.5, 0.1, 4)


def by_sample(edges, x):
    """Section after section, sample after sample."""
    sos, pad = dsp.butterworth(*edges), dsp.padding(edges)
    states = dsp.steady_state(sos).reshape(-1, 2)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        first = y[0]
        for (b0, b1, b2, _one, a1, a2), (z0, z1) in zip(sos, states):
            s0, s1, out = z0 * first, z1 * first, []
            for v in y:
                w = b0 * v + s0
                s0, s1 = b1 * v - a1 * w + s1, b2 * v - a2 * w
                out.append(w)
            y = np.array(out)
        y = y[::-1]
    return y[pad:-pad]


@pytest.mark.parametrize("edges", [EDGES, dsp.band_edges(FPS, 2.5, 0.0, 4), dsp.band_edges(FPS, 3.0, 0.2, 3)])
@pytest.mark.parametrize("n", [40, 97, 1000])
def test_scan_equals_the_recursion(edges, n):
    x = np.cumsum(np.random.default_rng(n).normal(size=(n, 2)), axis=0)
    got = dsp.zero_phase(edges, x)
    for c in range(2):
        assert np.allclose(got[:, c], by_sample(edges, x[:, c]), atol=1e-8)


def test_states_carry_over_a_cut():
    x = np.random.default_rng(1).normal(size=(500, 1))
    zero = np.zeros((len(dsp.steady_state(dsp.butterworth(*EDGES))), 1))
    whole, end = dsp.filter_from(EDGES, x, zero)
    first, middle = dsp.filter_from(EDGES, x[:180], zero)
    second, last = dsp.filter_from(EDGES, x[180:], middle)
    assert np.allclose(np.vstack([first, second]), whole) and np.allclose(last, end)
    own = dsp.filter_from(EDGES, x[180:], zero)[1]
    assert np.allclose(dsp.carried(EDGES, 320, middle[:, 0], own[:, 0]), end[:, 0])


def test_long_signals_take_linear_time():
    x = np.random.default_rng(2).normal(size=(200_000, 1))
    began = time.process_time()
    y = dsp.band_filter(x, FPS, 2.5, 0.1, 4)
    assert time.process_time() - began < 20
    # far from the ends a short part filters alike
    part = dsp.band_filter(x[100_000:110_000], FPS, 2.5, 0.1, 4)
    assert np.allclose(part[4000:6000], y[104_000:106_000], atol=1e-6)


def test_filter_across_slices(spark, recordings):
    got = filters.zero_phase(recordings, "value", "y", FPS, 0.1, KEYS, slices=17).toPandas()
    assert len(got) == recordings.count()
    values = recordings.toPandas()
    for video, rows in values.groupby("video", dropna=False):
        mine = got[got["video"].isna() if pd.isna(video) else got["video"] == video].sort_values("frame_idx")
        x = rows.sort_values("frame_idx")["value"].to_numpy()
        assert np.allclose(mine["y"], dsp.band_filter(x[:, None], FPS, 2.5, 0.1, 4)[:, 0], atol=1e-7)


# association

LM = "array<struct<x:double,y:double,z:double,v:double>>"


def by_frame(rows, fps, expected):
    """One tracker over a whole recording."""
    tracker, out = TR.Tracker(fps, expected), {}
    for frame in sorted({r[1] for r in rows}):
        here = sorted((r for r in rows if r[1] == frame), key=lambda r: r[2])
        tracks = tracker.step(frame, np.array([[r[4][0][0], r[4][0][1]] for r in here]), [r[3] for r in here])
        out |= {(frame, r[2]): t for r, t in zip(here, tracks)}
    return out


@pytest.mark.parametrize("expected", [None, "Left"])
def test_association_in_stretches(spark, expected):
    rng = np.random.default_rng(9)
    rows, frame = [], 0
    for _ in range(300):
        frame += int(rng.choice([1, 1, 1, 2, 4, 9]))
        for det in range(int(rng.integers(1, 4))):
            x, y = rng.random(2) * 0.4
            rows.append((1, frame, det, str(rng.choice(["Left", "Right"])), [(float(x), float(y), 0.0, 1.0)] * 21))
    rows += [(None, f, 0, "Left", [(0.5, 0.5, 0.0, 1.0)] * 21) for f in (0, 1, 2, 50, 51)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = TR.associate(spark.createDataFrame(rows, f"video long, frame_idx long, det_idx long, label string, lm {LM}"), FPS, expected).select("video", "frame_idx", "det_idx", "track").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = by_frame([r for r in rows if r[0] == 1], FPS, expected)
    assert {(r["frame_idx"], r["det_idx"]): r["track"] for r in got if r["video"] == 1} == want
    assert len(set(want.values())) > 20
    assert sorted((r["frame_idx"], r["track"]) for r in got if r["video"] is None) == [(0, 0), (1, 0), (2, 0), (50, 1), (51, 1)]


def test_forgotten_tracks_change_nothing():
    rng = np.random.default_rng(3)
    one, two = TR.Tracker(FPS, None), TR.Tracker(FPS, None)
    for frame in range(0, 400, 1):
        if rng.random() < 0.3:
            continue
        xy = rng.random((2, 2)) * 0.5
        assert one.step(frame, xy, [None, None]) == two.step(frame, xy, [None, None])
        two.forget(frame)
    assert len(two.state) < len(one.state) / 3
