"""Window and fold operators and the recording-level plan on signals with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.operators import kinematics as K
from oscilla.operators import sequence as S

T = np.arange(250) / 25.0
FPS = 25.0


def frame(spark, signals):
    rows = [
        (k, 0, i, None if np.isnan(v) else float(v)) for k, x in signals.items() for i, v in enumerate(x)
    ]
    return spark.createDataFrame(rows, "video long, clip long, frame_idx long, value double")


def series(df, column, video=0):
    rows = df.filter(F.col("video") == video).orderBy("frame_idx").select(column).collect()
    return np.array([np.nan if r[0] is None else r[0] for r in rows], dtype=float)


def test_interpolation_matches_numpy(spark):
    x = np.sin(T[:40]) * 10
    holes = x.copy()
    holes[[0, 1, 7, 8, 9, 39]] = np.nan
    ok = ~np.isnan(holes)
    want = np.interp(np.arange(40), np.flatnonzero(ok), holes[ok])
    df = frame(spark, {0: holes, 1: np.r_[5.0, np.full(9, np.nan)]})
    out = S.interpolate_gaps(df, "value", "y")
    assert np.allclose(series(out, "y"), want) and (series(out, "y", 1) == 0).all()


def test_hampel_removes_spikes(spark):
    x = 30 * np.sin(2 * np.pi * 1.5 * T)
    bad = x.copy()
    bad[[50, 120]] += 200
    out = S.hampel(frame(spark, {0: bad}), "value", "y")
    assert np.abs(series(out, "y") - x).max() < 25


def test_unwrap_matches_numpy_across_gaps(spark):
    path = np.cumsum(np.random.default_rng(1).normal(0.4, 0.6, 120))
    wrapped = (path + np.pi) % (2 * np.pi) - np.pi
    out = S.unwrap(frame(spark, {0: wrapped}), "value", "y")
    assert np.allclose(series(out, "y"), np.unwrap(wrapped))
    axial = (path + np.pi / 2) % np.pi - np.pi / 2
    out = S.unwrap(frame(spark, {0: axial}), "value", "y", axial=True)
    assert np.allclose(series(out, "y"), np.unwrap(2 * axial) / 2)
    holes = wrapped.copy()
    holes[40:44] = np.nan
    got = series(S.unwrap(frame(spark, {0: holes}), "value", "y"), "y")
    assert np.isnan(got[40:44]).all() and abs(got[44] - got[39]) <= np.pi + 1e-9


def test_one_euro_restarts_after_gaps(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=60))
    x[10] = x[20] = x[21] = np.nan

    def alpha(c):
        return 1 / (1 + (1 / (2 * np.pi * c)) * FPS)

    want, prev, dxh, gap = [], None, 0.0, 0
    for v in x:
        if np.isnan(v):
            gap += 1
            want.append(np.nan)
            continue
        if prev is None or gap > 1:
            prev, dxh = v, 0.0
        else:
            dxh = alpha(2.0) * (v - prev) * FPS + (1 - alpha(2.0)) * dxh
            a = alpha(1.5 + 50 * abs(dxh))
            prev = a * v + (1 - a) * prev
        gap = 0
        want.append(prev)
    got = series(S.one_euro(frame(spark, {0: x}), "value", "y", FPS), "y")
    assert np.allclose(got, want, equal_nan=True)


def test_spike_rejection_is_wrap_aware(spark):
    x = np.array([3.1, -3.1, 3.1, 0.0, 3.1, np.nan, -3.1, 1.2])
    got = series(S.reject_spikes(frame(spark, {0: x}), "value", "y", FPS), "y")
    assert np.isnan(got).tolist() == [False, False, False, True, False, True, False, False]


@pytest.mark.parametrize(
    ("values", "onset", "effect"),
    [
        ([10.0, 10, 10, 10, 10, 10], 1.0, 0.0),
        ([10.0, 9], None, None),
        ([60.0, 50, 40, 30, 20, 10], 0.0, 300 / 5.5 / (55 / 55) * 0.0 + (55 - 15) / 55 * 100),
        ([0.0, 0, 0], None, None),
    ],
)
def test_decrement(spark, values, onset, effect):
    row = spark.range(1).select(
        S.decrement_onset(F.array(*map(F.lit, values))).alias("o"),
        S.sequence_effect_pct(F.array(*map(F.lit, values))).alias("e"),
    ).first()
    assert row["o"] == (pytest.approx(onset) if onset is not None else None)
    assert row["e"] == (pytest.approx(effect) if effect is not None else None)


def test_activity_segment(spark):
    rate = np.zeros(400)
    rate[100:150] = 50.0
    rate[180:330] = 50.0
    rows = [(0, i, float(v)) for i, v in enumerate(rate)]
    df = spark.createDataFrame(rows, "video long, frame_idx long, rate double")
    got = S.activity_segment(df, "rate", FPS).first()
    # both islands merge (gap below 2.5 s) and the ten-second limit cuts the tail
    assert got["ps_start"] == pytest.approx(90, abs=4) and got["ps_end"] <= got["ps_start"] + 249
    still = spark.createDataFrame([(0, i, 0.0) for i in range(50)], "video long, frame_idx long, rate double")
    assert S.activity_segment(still, "rate", FPS).count() == 0


def test_occlusion_gaps(spark):
    x = np.ones(20)
    x[[0, 1, 5, 6, 7, 12, 19]] = np.nan
    row = S.occlusion_gaps(frame(spark, {0: x}), F.col("value").isNotNull(), FPS).first()
    assert (row["n_gaps"], row["longest_gap_frames"], row["total_gap_frames"]) == (2, 3, 4)
    assert row["detection_rate"] == pytest.approx(13 / 17)


@pytest.fixture(scope="module")
def features(spark):
    base = 2 * np.pi * 1.5 * T
    sine = 30 * np.sin(base)
    holes = sine.copy()
    holes[40:45] = np.nan
    pause = np.concatenate([sine[:104], np.full(40, sine[103]), sine[104:210]])
    signals = {
        0: sine,
        1: np.linspace(40, 20, 250) * np.sin(base),
        2: 30 * np.sin(2 * np.pi * (1 + 0.075 * T) * T),
        3: holes,
        4: sine + 500 * (T / 10) ** 3,
        5: np.zeros(250),
        6: sine[:9],
        7: pause,
    }
    out = K.recording_features(frame(spark, signals), "value", FPS)
    return out.toPandas().set_index("video")


def test_sine_features(features):
    f = features.loc[0]
    assert f["mean_frequency"] == pytest.approx(1.5, rel=0.02)
    assert f["mean_amplitude"] == pytest.approx(60, rel=0.03)
    assert abs(f["velocity_decrement_pct"]) < 3 and f["num_arrests"] == 0
    assert f["signal_quality"] > 0.9


def test_decay_chirp_gap_drift(features):
    assert features.loc[1, "norm_decrement_slope"] < -3
    assert features.loc[1, "amp_decrement_onset"] < 1 and features.loc[1, "amp_decrement_pct"] > 20
    assert features.loc[2, "raw_cycle_duration_slope"] < 0
    assert features.loc[3, "sq_signal_coverage"] == pytest.approx(245 / 250)
    assert features.loc[3, "mean_amplitude"] == pytest.approx(60, rel=0.05)
    assert features.loc[4, "mean_amplitude"] == pytest.approx(60, rel=0.05)


def test_guards_and_pause(features):
    assert 5 not in features.index and 6 not in features.index
    assert features.loc[7, "num_hesitations"] + features.loc[7, "num_arrests"] >= 1


def test_short_half_cycles_are_thinned(spark):
    rows = [(0, 1, 5.0), (10, -1, -5.0), (12, 1, -1.0), (14, -1, -4.0), (24, 1, 5.0)]
    arr = F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("frame_idx"), F.lit(e).alias("etype"), F.lit(h).alias("height"))
            for i, e, h in rows
        ]
    )
    got = spark.range(1).select(K.drop_short_half_cycles(arr, F.lit(0.0), 5).alias("x")).first()["x"]
    assert [r["frame_idx"] for r in got] == [0, 10, 24]


def test_feature_columns_of_the_whole_signal(features):
    # the path between two extrema of a sine is its peak-to-trough height
    assert features.loc[0, "integral_amplitude"] == pytest.approx(60, rel=0.04)
    assert not features["wrist_z_used"].any()


def test_anchor_intervals_count_cycles_without_amplitude(spark):
    heights = [(0, 1, 10.0), (10, -1, 0.0), (20, 1, 10.0), (30, -1, 12.0), (40, 1, 8.0), (50, -1, 0.0), (60, 1, 10.0)]
    df = spark.createDataFrame([(0, 0, *h) for h in heights], "video long, clip long, frame_idx long, etype int, height double")
    cycles = K.build_cycles(df, 10.0)
    assert sorted((r["lo"], r["hi"], r["amplitude"]) for r in cycles.collect()) == [(0, 20, 10.0), (40, 60, 9.0)]
    got = K.anchor_intervals(df, cycles, 10.0).orderBy("cycle_no").collect()
    assert [(r["cycle_no"], r["interval_s"]) for r in got] == [(0, 2.0), (1, 2.0), (2, 2.0)]
    (row,) = K.recording_series(cycles, df, 10.0).collect()
    assert row["peak_times"] == [0.0, 4.0] and row["amplitudes"] == [10.0, 9.0] and row["trend_line"] == pytest.approx([10.0, 9.0])
    assert row["detected_peak_times"] == [0.0, 2.0, 4.0, 6.0] and row["trough_times"] == [1.0, 3.0, 5.0]


def test_startup_transient_takes_its_interval(spark):
    heights = [(10 * i, 1 if i % 2 == 0 else -1, (200.0 if i == 0 else 10.0) if i % 2 == 0 else 0.0) for i in range(11)]
    df = spark.createDataFrame([(0, 0, *h) for h in heights], "video long, clip long, frame_idx long, etype int, height double")
    cycles = K.build_cycles(df, 10.0)
    assert [(r["etype"], r["skipped"], r["cycle_no"]) for r in cycles.orderBy("lo").collect()] == [(1, 1, i) for i in range(4)]
    assert K.anchor_intervals(df, cycles, 10.0).count() == 4


def test_refined_heights(spark):
    x = [0.0, 1.0, 3.0, 2.5, 0.0, -2.0, -1.9, 0.0]
    packed = spark.createDataFrame([(0, 0, x)], "video long, clip long, band array<double>")
    rows = [(0, 0, 2, 1, 3.0), (0, 0, 5, -1, -2.0), (0, 0, 0, -1, 0.0), (0, 0, 7, 1, 0.0)]
    got = {r["frame_idx"]: r["height"] for r in K.refined(spark.createDataFrame(rows, "video long, clip long, frame_idx long, etype int, height double"), packed, "band").collect()}
    for i in (2, 5):
        a, b, c = np.polyfit([-1, 0, 1], x[i - 1 : i + 2], 2)
        assert got[i] == pytest.approx(c - b * b / (4 * a))
    assert got[0] == 0.0 and got[7] == 0.0


def test_wrist_depth_is_reported(spark):
    noise = np.random.default_rng(1).normal(size=250) * 0.02
    depth = np.sin(2 * np.pi * 1.5 * T) + noise
    packed = spark.createDataFrame(
        [(0, depth.tolist()), (1, [float("nan")] * 200 + depth[200:].tolist()), (2, []), (3, None)], "video long, z array<double>"
    )
    got = {r["video"]: r["u"] for r in packed.select("video", K.wrist_usable(F.col("z"), FPS).alias("u")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}
