"""Signal queries on frame-ordered recordings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from oscilla.config import DEFAULTS
from oscilla.functions import dsp
from oscilla.operators import kinematics as K
from oscilla.operators import sequence as S
from oscilla.operators.borders import totals
from oscilla.operators.filters import zero_phase
from oscilla.operators.ordering import SLICE, slice_by_order
from oscilla.plans.registry import query
from oscilla.session import durable
from oscilla.sources.fixtures import cycles, frames, with_ctes

FPS = 25.0
KEYS = ["video", "clip"]
ROW = [*KEYS, "frame_idx"]
W = "PARTITION BY video, clip ORDER BY frame_idx"


def sliced(df):
    """Extrema of recordings, cut by range like their frames."""
    return slice_by_order(df, KEYS, ["frame_idx"])


def _out(df, **columns):
    return df.select(*ROW, *[F.round(c, d).alias(n) for n, (c, d) in columns.items()])


@query(
    "gap_interp",
    with_ctes(
        "frames",
        body=f"""
, p AS (SELECT *, last_value(CASE WHEN seen IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER a AS bi,
          last_value(seen IGNORE NULLS) OVER a AS bv,
          first_value(CASE WHEN seen IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER b AS ai,
          first_value(seen IGNORE NULLS) OVER b AS av, count(seen) OVER (PARTITION BY video, clip) AS n
   FROM frames WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      b AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT video, clip, frame_idx, round(CASE WHEN n < 2 THEN 0 ELSE
  coalesce(seen, bv + (av - bv) * (frame_idx - bi) / nullif(ai - bi, 0), bv, av) END, 6) AS filled FROM p""",
    ),
)
def gap_interp(spark, sf_dir):
    df = S.interpolate_gaps(frames(spark, sf_dir), "seen", "filled")
    return _out(df, filled=("filled", 6))


@query(
    "hampel",
    with_ctes(
        "frames",
        body=f"""
, p AS (SELECT *, list(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS patch FROM frames)
, q AS (SELECT *, list_median(patch) AS med FROM p)
SELECT video, clip, frame_idx, round(CASE WHEN abs(value - med) > 3.0 * 1.4826
  * list_median(list_transform(patch, lambda x: abs(x - med))) THEN med ELSE value END, 4) AS cleaned FROM q""",
    ),
)
def hampel(spark, sf_dir):
    return _out(S.hampel(frames(spark, sf_dir), "value", "cleaned"), cleaned=("cleaned", 4))


@query(
    "moving_avg",
    with_ctes(
        "frames",
        body="""
SELECT video, clip, frame_idx, round(avg(value) OVER (PARTITION BY video, clip ORDER BY frame_idx
  RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value_smooth FROM frames WHERE seen IS NOT NULL""",
    ),
)
def moving_avg(spark, sf_dir):
    tracked = frames(spark, sf_dir).filter(F.col("seen").isNotNull())
    return _out(S.moving_average(tracked, ["value"], 3), value_smooth=("value_smooth", 6))


@query(
    "one_euro",
    with_ctes(
        "frames",
        body="""
, packed AS (SELECT video, clip, list({'i': frame_idx, 'v': seen, 'x': CAST(NULL AS DOUBLE),
     'dx': CAST(0 AS DOUBLE), 'gap': 0, 'ys': CAST([] AS DOUBLE[])} ORDER BY frame_idx) AS s FROM frames GROUP BY ALL)
, folded AS (SELECT video, clip, s, list_reduce(list_prepend({'i': CAST(-1 AS BIGINT), 'v': CAST(NULL AS DOUBLE),
     'x': CAST(NULL AS DOUBLE), 'dx': CAST(0 AS DOUBLE), 'gap': 0, 'ys': CAST([] AS DOUBLE[])}, s), lambda a, b:
   CASE WHEN b.v IS NULL THEN {'i': b.i, 'v': b.v, 'x': a.x, 'dx': a.dx, 'gap': a.gap + 1, 'ys': list_append(a.ys, NULL)}
        WHEN a.x IS NULL OR a.gap > 1 THEN {'i': b.i, 'v': b.v, 'x': b.v, 'dx': CAST(0 AS DOUBLE), 'gap': 0, 'ys': list_append(a.ys, b.v)}
        ELSE {'i': b.i, 'v': b.v,
          'x': AL(1.5 + 50 * abs(DXH)) * b.v + (1 - AL(1.5 + 50 * abs(DXH))) * a.x, 'dx': DXH, 'gap': 0,
          'ys': list_append(a.ys, AL(1.5 + 50 * abs(DXH)) * b.v + (1 - AL(1.5 + 50 * abs(DXH))) * a.x)} END).ys AS ys
  FROM packed)
SELECT video, clip, unnest(range(len(ys))) AS frame_idx, round(unnest(ys), 6) AS smooth FROM folded""",
    )
    .replace("AL(1.5 + 50 * abs(DXH))", "(1 / (1 + (1 / (2 * pi() * (1.5 + 50 * abs(DXH)))) / 0.04))")
    .replace(
        "DXH",
        "((1 / (1 + (1 / (2 * pi() * 2.0)) / 0.04)) * ((b.v - a.x) / 0.04)"
        " + (1 - (1 / (1 + (1 / (2 * pi() * 2.0)) / 0.04))) * a.dx)",
    ),
)
def one_euro(spark, sf_dir):
    df = S.one_euro(frames(spark, sf_dir), "seen", "smooth", FPS)
    return _out(df, smooth=("smooth", 6))


_ANGLE_SQL = "CASE WHEN seen IS NOT NULL THEN seen - 2 * pi() * floor(seen / (2 * pi())) - pi() END"


def _angles(spark, sf_dir):
    two_pi = 2 * math.pi
    wrapped = F.pmod(F.col("seen"), F.lit(two_pi)) - math.pi
    return frames(spark, sf_dir).withColumn("angle", wrapped)


@query(
    "spike_reject",
    with_ctes(
        "frames",
        body=f"""
, a AS (SELECT video, clip, frame_idx, {_ANGLE_SQL} AS angle FROM frames)
, v AS (SELECT *, abs(angle - lag(angle) OVER ({W})) AS dp, abs(angle - lead(angle) OVER ({W})) AS dn FROM a WHERE angle IS NOT NULL)
SELECT a.video, a.clip, a.frame_idx, CASE WHEN coalesce(least(dp, 2 * pi() - dp) > pi() / 2
   AND least(dn, 2 * pi() - dn) > pi() / 2, false) THEN NULL ELSE round(a.angle, 6) END AS kept
FROM a LEFT JOIN v USING (video, clip, frame_idx)""",
    ),
)
def spike_reject(spark, sf_dir):
    return _out(S.reject_spikes(_angles(spark, sf_dir), "angle", "kept", FPS), kept=("kept", 6))


@query(
    "unwrap_phase",
    with_ctes(
        "frames",
        body=f"""
, a AS (SELECT video, clip, frame_idx, {_ANGLE_SQL} AS angle FROM frames)
, d AS (SELECT *, round_even((angle - lag(angle) OVER ({W})) / (2 * pi()), 0) AS t,
               round_even((2 * angle - lag(2 * angle) OVER ({W})) / (2 * pi()), 0) AS t2 FROM a WHERE angle IS NOT NULL)
, u AS (SELECT *, sum(coalesce(t, 0)) OVER ({W}) AS n1, sum(coalesce(t2, 0)) OVER ({W}) AS n2 FROM d)
SELECT a.video, a.clip, a.frame_idx, round(a.angle - 2 * pi() * n1, 6) AS phase,
       round((2 * a.angle - 2 * pi() * n2) / 2, 6) AS axial_phase
FROM a LEFT JOIN u USING (video, clip, frame_idx)""",
    ),
)
def unwrap_phase(spark, sf_dir):
    df = S.unwrap(_angles(spark, sf_dir), "angle", "phase")
    df = S.unwrap(df, "angle", "axial_phase", axial=True)
    return _out(df, phase=("phase", 6), axial_phase=("axial_phase", 6))


@query(
    "angular_velocity",
    with_ctes(
        "frames",
        body=f"""
, g AS (SELECT *, lag(value) OVER ({W}) AS p, lead(value) OVER ({W}) AS n FROM frames)
SELECT video, clip, frame_idx, round(25.0 * CASE WHEN p IS NULL THEN n - value WHEN n IS NULL THEN value - p
   ELSE (n - p) / 2 END, 4) AS rate FROM g""",
    ),
)
def angular_velocity(spark, sf_dir):
    return _out(S.gradient(frames(spark, sf_dir), "value", "rate", FPS), rate=("rate", 4))


@query(
    "parabolic",
    with_ctes(
        "frames",
        body=f"""
, s AS (SELECT video, clip, frame_idx, value / 7.0 AS c FROM frames)
, g AS (SELECT *, lag(c) OVER ({W}) AS p, lead(c) OVER ({W}) AS n FROM s)
, v AS (SELECT *, p - 2 * c + n AS den, c - 0.25 * (p - n) * (0.5 * (p - n) / nullif(p - 2 * c + n, 0)) AS vx FROM g)
SELECT video, clip, frame_idx, round(CASE WHEN p IS NULL OR n IS NULL OR abs(den) < 1e-12
   OR (c >= p AND c >= n AND vx < c) OR (c <= p AND c <= n AND vx > c) THEN c ELSE vx END, 6) AS vertex
FROM v""",
    ),
)
def parabolic(spark, sf_dir):
    scaled = frames(spark, sf_dir).withColumn("scaled", F.col("value") / 7.0)
    return _out(S.parabolic_vertex(scaled, "scaled", "vertex"), vertex=("vertex", 6))


def _section_sql(name, source, row, states):
    """One second-order section over the list ``ys`` of each recording, as a fold; it starts in its steady state."""
    b0, b1, b2, _, a1, a2 = (repr(float(c)) for c in row)
    z0, z1 = (repr(float(z)) for z in states)
    w = f"({b0} * b.v + a.s0)"
    return f"""
, {name} AS (SELECT video, clip, x1, list_reduce(list_prepend({{'v': CAST(0 AS DOUBLE), 's0': {z0} * x1, 's1': {z1} * x1, 'ys': CAST([] AS DOUBLE[])}},
   list_transform(ys, lambda y: {{'v': y, 's0': CAST(0 AS DOUBLE), 's1': CAST(0 AS DOUBLE), 'ys': CAST([] AS DOUBLE[])}})), lambda a, b:
   {{'v': b.v, 's0': {b1} * b.v - {a1} * {w} + a.s1, 's1': {b2} * b.v - {a2} * {w}, 'ys': list_append(a.ys, {w})}}).ys AS ys FROM {source})"""


def _zero_phase_sql():
    """Odd extension, all sections forward, all sections backward."""
    edges = dsp.band_edges(FPS, DEFAULTS.cutoff_hz, DEFAULTS.highpass_hz, DEFAULTS.filter_order)
    sos, pad = dsp.butterworth(*edges), dsp.padding(edges)
    states = dsp.steady_state(sos).reshape(-1, 2)
    parts = [
        f"""
, p AS (SELECT video, clip, list(CAST(value AS DOUBLE) ORDER BY frame_idx) AS v, count(*) AS n FROM frames GROUP BY ALL)
, e0 AS (SELECT video, clip, list_concat(list_concat(list_transform(range({pad}, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v),
     list_transform(range(1, {pad + 1}), lambda i: 2 * v[n] - v[n - i])) AS ys FROM p WHERE n >= {dsp.shortest_filtered(DEFAULTS.filter_order)})"""
    ]
    source = "e0"
    for way in ("f", "b"):
        parts.append(f"\n, {way} AS (SELECT video, clip, ys[1] AS x1, ys FROM {source})")
        source = way
        for k, (row, state) in enumerate(zip(sos, states, strict=True)):
            parts.append(_section_sql(f"{way}{k}", source, row, state))
            source = f"{way}{k}"
        parts.append(f"\n, r{way} AS (SELECT video, clip, list_reverse(ys) AS ys FROM {source})")
        source = f"r{way}"
    parts.append(
        f"""
SELECT p.video, p.clip, unnest(range(n)) AS frame_idx, round(unnest(coalesce(ys[{pad + 1}:{pad} + n], v)), 4) AS band
FROM p LEFT JOIN rb USING (video, clip)"""
    )
    return with_ctes("frames", body="".join(parts))


@query("zero_phase_filter", _zero_phase_sql())
def zero_phase_filter(spark, sf_dir):
    band = zero_phase(frames(spark, sf_dir), "value", "band", FPS, DEFAULTS.highpass_hz, KEYS)
    return _out(band, band=("band", 4))


_EXTREMA_SQL = f"""
, c AS (SELECT *, value - avg(value) OVER (PARTITION BY video, clip) AS x FROM frames)
, s AS (SELECT *, CASE WHEN round(x, 9) < 0 THEN -1 ELSE 1 END AS sgn FROM c)
, z AS (SELECT *, lead(sgn) OVER ({W}) <> sgn AS crossing FROM s)
, zc AS (SELECT video, clip, frame_idx AS zs, sgn, lead(frame_idx) OVER ({W}) AS ze, lead(sgn) OVER ({W}) AS etype
         FROM z WHERE crossing)
, h AS (SELECT zc.video, clip, zs, etype, arg_max(frame_idx, etype * value * 1e6 - frame_idx) AS frame_idx
  FROM zc JOIN frames USING (video, clip) WHERE ze - zs BETWEEN 2 AND 100 AND frame_idx BETWEEN zs AND ze GROUP BY ALL)
, raw AS (SELECT h.video, h.clip, h.etype, h.frame_idx, f.value AS height FROM h JOIN frames f USING (video, clip, frame_idx))"""

_ALT_SQL = (
    _EXTREMA_SQL
    + f"""
, r AS (SELECT *, sum(CAST(fresh AS INT)) OVER ({W}) AS run FROM
   (SELECT *, coalesce(lag(etype) OVER ({W}) <> etype, true) AS fresh FROM raw))
, alt AS (SELECT video, clip, any_value(etype) AS etype, arg_max(frame_idx, etype * height * 1e6 - frame_idx) AS frame_idx,
          arg_max(height, etype * height * 1e6 - frame_idx) AS height FROM r GROUP BY video, clip, run)"""
)


def _raw_extrema(spark, sf_dir):
    df = frames(spark, sf_dir).select(*ROW, SLICE, "value")
    # round keeps the sign of a centred sample independent of summation order
    summed = totals(df, KEYS, {"_s": F.sum("value"), "_c": F.count("value")})
    centred = summed.withColumn("centred", F.round(F.col("value") - F.col("_s") / F.col("_c"), 9))
    return df, S.zero_crossing_extrema(centred, "value", "centred", 2, 100)


@query(
    "zero_crossings",
    with_ctes(
        "frames",
        body=_EXTREMA_SQL + " SELECT video, clip, etype, frame_idx, round(height, 4) AS height FROM raw",
    ),
)
def zero_crossings(spark, sf_dir):
    _, raw = _raw_extrema(spark, sf_dir)
    return raw.select(*KEYS, "etype", "frame_idx", F.round("height", 4).alias("height"))


@query(
    "alternating_extrema",
    with_ctes(
        "frames",
        body=_ALT_SQL + " SELECT video, clip, etype, frame_idx, round(height, 4) AS height FROM alt",
    ),
)
def alternating_extrema(spark, sf_dir):
    _, raw = _raw_extrema(spark, sf_dir)
    return S.alternate(sliced(raw)).select(*KEYS, "etype", "frame_idx", F.round("height", 4).alias("height"))


_CYCLES_SQL = (
    _ALT_SQL
    + f"""
, st AS (SELECT *, lead(height) OVER ({W}) AS opp, lead(height, 2) OVER ({W}) AS fin, lead(frame_idx, 2) OVER ({W}) AS hi,
    count(*) OVER (PARTITION BY video, clip, etype) AS anchors FROM alt)
, cy AS (SELECT video, clip, etype, frame_idx AS lo, hi, etype * ((height - opp) + (fin - opp)) / 2 AS amplitude, (hi - frame_idx) / {FPS} AS interval_s
  FROM st WHERE anchors >= 3 AND hi IS NOT NULL)
, ty AS (SELECT video, clip, etype, count(*) FILTER (amplitude > 0) AS n, CASE WHEN count(*) >= 2 THEN stddev_pop(interval_s) / avg(interval_s) ELSE 1e9 END AS cv
  FROM cy GROUP BY ALL)
, be AS (SELECT video, clip, etype FROM ty WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY video, clip ORDER BY n DESC, cv, etype DESC) = 1)
, nu AS (SELECT cy.*, row_number() OVER w - 1 AS no, count(*) OVER (PARTITION BY video, clip) AS n, first_value(amplitude) OVER w AS head
  FROM cy JOIN be USING (video, clip, etype) WHERE amplitude > 0 WINDOW w AS (PARTITION BY video, clip ORDER BY lo))
, re AS (SELECT video, clip, median(amplitude) FILTER (no > 0) AS rest FROM nu GROUP BY ALL)
, full_cycle AS (SELECT *, no - skip AS cycle_no FROM (SELECT nu.*, CASE WHEN n >= 4 AND rest > 1e-6 AND head > {DEFAULTS.startup_transient_factor} * rest
    THEN 1 ELSE 0 END AS skip FROM nu JOIN re USING (video, clip)) WHERE no >= skip AND n - skip >= 2)"""
)


@query(
    "cycle_series",
    with_ctes(
        "frames",
        body=_CYCLES_SQL
        + f"""
SELECT video, clip, cycle_no, etype, lo, hi, round(amplitude, 6) AS amplitude, round(interval_s, 6) AS interval_s,
  round(regr_intercept(amplitude, lo / {FPS}) OVER p + regr_slope(amplitude, lo / {FPS}) OVER p * lo / {FPS}, 6) AS trend,
  (SELECT count(*) FROM alt WHERE alt.video = f.video AND alt.clip = f.clip AND alt.etype = 1) AS n_peaks,
  (SELECT count(*) FROM alt WHERE alt.video = f.video AND alt.clip = f.clip AND alt.etype = -1) AS n_troughs
FROM full_cycle f WINDOW p AS (PARTITION BY video, clip)""",
    ),
)
def cycle_series(spark, sf_dir):
    _, raw = _raw_extrema(spark, sf_dir)
    extrema = durable(S.alternate(sliced(raw)))
    found = durable(K.build_cycles(extrema, FPS))
    drawn = K.recording_series(found, extrema, FPS).select(
        *KEYS,
        F.posexplode("trend_line").alias("cycle_no", "trend"),
        F.size("detected_peak_times").cast("long").alias("n_peaks"),
        F.size("trough_times").cast("long").alias("n_troughs"),
    )
    rounded = {c: F.round(c, 6) for c in ("amplitude", "interval_s", "trend")}
    return found.drop("skipped").join(drawn, [*KEYS, "cycle_no"]).withColumns(rounded)


@query(
    "integral_amplitude",
    with_ctes(
        "frames",
        body=_ALT_SQL
        + f"""
, g AS (SELECT video, clip, frame_idx, abs(25.0 * CASE WHEN p IS NULL THEN n - value WHEN n IS NULL THEN value - p ELSE (n - p) / 2 END) AS v
   FROM (SELECT *, lag(value) OVER ({W}) AS p, lead(value) OVER ({W}) AS n FROM frames))
, tr AS (SELECT *, (v + lag(v) OVER ({W})) / 2 / 25.0 AS area FROM g)
, seg AS (SELECT video, clip, frame_idx AS lo, lead(frame_idx) OVER ({W}) AS hi FROM alt)
, ex AS (SELECT seg.video, seg.clip, lo, sum(area) AS e FROM seg JOIN tr ON tr.video = seg.video AND tr.clip = seg.clip
         AND frame_idx > lo AND frame_idx <= hi GROUP BY ALL)
SELECT video, clip, CASE WHEN count(*) >= 2 THEN round(avg(e), 9) END AS integral_amplitude FROM ex GROUP BY ALL""",
    ),
)
def integral_amplitude(spark, sf_dir):
    df, raw = _raw_extrema(spark, sf_dir)
    rate = S.gradient(df, "value", "rate", FPS)
    out = S.integral_amplitude(rate, S.alternate(sliced(raw)), "rate", FPS)
    return out.select(*KEYS, F.round("integral_amplitude", 9).alias("integral_amplitude"))


@query(
    "occlusion_gaps",
    with_ctes(
        "frames",
        body=f"""
, h AS (SELECT video, clip, frame_idx, nullif(frame_idx - lag(frame_idx) OVER ({W}) - 1, 0) AS gap FROM frames WHERE seen IS NOT NULL)
SELECT video, clip, round(count(*) / (max(frame_idx) - min(frame_idx) + 1), 6) AS detection_rate, count(gap) AS n_gaps,
  coalesce(max(gap), 0) AS longest_gap_frames, round(coalesce(max(gap), 0) / 25.0, 6) AS longest_gap_s,
  round(coalesce(avg(gap), 0), 6) AS mean_gap_frames, CAST(coalesce(sum(gap), 0) AS BIGINT) AS total_gap_frames,
  round(coalesce(sum(gap), 0) / (max(frame_idx) - min(frame_idx) + 1), 6) AS gap_fraction FROM h GROUP BY ALL""",
    ),
)
def occlusion_gaps(spark, sf_dir):
    out = S.occlusion_gaps(frames(spark, sf_dir), F.col("seen").isNotNull(), FPS)
    rounded = ("detection_rate", "longest_gap_s", "mean_gap_frames", "gap_fraction")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "nearest_frame",
    with_ctes(
        "frames",
        body=f"""
, p AS (SELECT *, last_value(CASE WHEN seen IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER a AS bi,
          first_value(CASE WHEN seen IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER b AS ai
   FROM frames WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT p.video, p.clip, p.frame_idx, f.frame_idx AS nearest_idx, f.value AS nearest_value
FROM p LEFT JOIN frames f ON f.video = p.video AND f.clip = p.clip AND f.frame_idx =
  CASE WHEN bi IS NULL THEN ai WHEN ai IS NULL THEN bi WHEN p.frame_idx - bi <= ai - p.frame_idx THEN bi ELSE ai END""",
    ),
)
def nearest_frame(spark, sf_dir):
    df = S.nearest_tracked(frames(spark, sf_dir), F.col("seen").isNotNull(), ["value"])
    return df.select(
        *ROW, F.col("nearest.i").alias("nearest_idx"), F.col("nearest.value").alias("nearest_value")
    )


@query(
    "cycle_features",
    with_ctes(
        "cycles",
        body="""
, t AS (SELECT *, coalesce(sum(interval_s) OVER (PARTITION BY video, clip ORDER BY cycle_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ts FROM cycles)
, a AS (SELECT video, clip, count(*) AS n, avg(amplitude) AS ma, stddev_pop(amplitude) AS sa, avg(interval_s) AS mi,
   stddev_pop(interval_s) AS si, stddev_samp(interval_s) AS ssi, avg(peak_velocity) AS mv, stddev_pop(peak_velocity) AS sv,
   stddev_samp(peak_velocity) AS ssv,
   CASE WHEN count(*) >= 2 THEN regr_slope(amplitude, ts) END AS ba, CASE WHEN count(*) >= 3 THEN regr_slope(interval_s, cycle_no) END AS bi,
   CASE WHEN count(*) >= 3 THEN regr_slope(peak_velocity, cycle_no) END AS bv,
   CASE WHEN count(*) >= 4 AND stddev_pop(amplitude) > 1e-9 AND stddev_pop(peak_velocity) > 1e-9 THEN corr(amplitude, peak_velocity) END AS r
   FROM t GROUP BY ALL)
SELECT video, clip, n AS total_cycles, round(ma, 6) AS mean_amplitude, round(coalesce(CASE WHEN ma > 1e-9 THEN sa / ma * 100 END, 0), 6) AS amplitude_cv,
  round(1 / mi, 6) AS mean_frequency, round(mi, 6) AS avg_cycle_duration, round(coalesce(CASE WHEN mi > 1e-9 THEN si / mi * 100 END, 0), 6) AS rhythm_cv,
  round(CASE WHEN n >= 2 AND mi > 1e-9 THEN ssi / mi * 100 END, 6) AS cycle_duration_cv, round(CASE WHEN n >= 3 THEN ba END, 6) AS raw_amp_slope,
  round(CASE WHEN ma > 1 THEN greatest(-50, least(50, ba / ma * 100)) END, 6) AS norm_decrement_slope, round(bi, 6) AS raw_cycle_duration_slope,
  round(CASE WHEN mi > 1e-9 THEN greatest(-50, least(50, bi / mi * 100)) END, 6) AS norm_ti_slope, round(mv, 4) AS peak_velocity,
  round(CASE WHEN n >= 2 AND mv > 1e-9 THEN ssv / mv * 100 END, 6) AS peak_velocity_cv, round(bv, 4) AS raw_velocity_slope,
  round(CASE WHEN mv > 1e-9 THEN greatest(-50, least(50, bv / mv * 100)) END, 6) AS norm_velocity_decrement_slope,
  round(r, 6) AS amp_vel_coupling FROM a""",
    ),
)
def cycle_features(spark, sf_dir):
    out = S.cycle_features(cycles(spark, sf_dir))
    digits = {"peak_velocity": 4, "raw_velocity_slope": 4}
    return out.select(
        *KEYS,
        "total_cycles",
        *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns if c not in (*KEYS, "total_cycles")],
    )


@query(
    "interruptions",
    with_ctes(
        "cycles",
        body="""
, m AS (SELECT *, median(interval_s) OVER (PARTITION BY video, clip) AS med, count(*) OVER (PARTITION BY video, clip) AS n FROM cycles WHERE interval_s > 1e-6)
, f AS (SELECT *, n >= 2 AND interval_s > greatest(1.5 * med, 0.8) AS arrest, n >= 2 AND interval_s > greatest(1.25 * med, 0.4) AS slow FROM m)
SELECT video, clip, count(*) FILTER (slow AND NOT arrest) AS num_hesitations, count(*) FILTER (arrest) AS num_arrests,
  count(*) FILTER (n >= 2 AND interval_s > 2 * med) AS num_interruptions,
  round(coalesce(max(interval_s) FILTER (slow OR arrest), 0), 6) AS max_pause_duration_s,
  round(coalesce(sum(interval_s) FILTER (slow OR arrest) / sum(interval_s), 0), 6) AS pause_time_ratio FROM f GROUP BY ALL""",
    ),
)
def interruptions(spark, sf_dir):
    out = S.interruptions(cycles(spark, sf_dir), "interval_s")
    return out.withColumns({c: F.round(c, 6) for c in ("max_pause_duration_s", "pause_time_ratio")})


@query(
    "decrement",
    with_ctes(
        "cycles",
        body="""
, n AS (SELECT video, clip, list(amplitude ORDER BY cycle_no) AS x, count(*) AS n FROM cycles GROUP BY ALL)
, sm AS (SELECT video, clip, n, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda j:
     (x[abs(j - 1) + 1] + x[j + 1] + x[CASE WHEN j + 1 < n THEN j + 2 ELSE 2 * n - 2 - j END]) / 3)) AS y FROM n WHERE n >= 3)
, ov AS (SELECT video, clip, any_value(n) AS n, avg(y) AS my, regr_slope(y, i) / avg(y) * 100 AS pct,
     least(greatest(3, any_value(n) // 3), any_value(n) - 1) AS w FROM sm GROUP BY video, clip)
, loc AS (SELECT o.video, o.clip, st.i AS s, regr_slope(e.y, e.i) / avg(e.y) * 100 AS p, avg(e.y) AS m FROM ov o
     JOIN sm st USING (video, clip) JOIN sm e ON e.video = o.video AND e.clip = o.clip AND e.i >= st.i AND e.i < st.i + o.w
     WHERE st.i <= o.n - o.w GROUP BY o.video, o.clip, st.i)
, first AS (SELECT video, clip, min(s) AS s FROM loc WHERE m >= 1e-6 AND round(p, 9) < -2 GROUP BY ALL)
, pc AS (SELECT video, clip, CAST(greatest(2, least(4, n // 3)) AS INT) AS w, x, n FROM n)
, eff AS (SELECT video, clip, n, list_median(x[1:w]) AS e, list_median(x[n - w + 1:n]) AS l FROM pc)
SELECT eff.video, eff.clip, round(CASE WHEN my >= 1e-6 THEN CASE WHEN round(pct, 9) > -1 THEN 1 ELSE coalesce(s / greatest(ov.n - 1, 1), 0.85) END END, 6) AS decrement_onset,
  round(CASE WHEN eff.n >= 4 AND e > 1e-6 THEN (e - l) / e * 100 END, 6) AS sequence_effect_pct
FROM eff LEFT JOIN ov USING (video, clip) LEFT JOIN first USING (video, clip)""",
    ),
)
def decrement(spark, sf_dir):
    packed = S.pack(cycles(spark, sf_dir), KEYS, "cycle_no", ["amplitude"])
    values = F.transform("samples", lambda s: s["amplitude"])
    arrays = packed.select(*KEYS, values.alias("x"))
    return arrays.select(
        *KEYS,
        F.round(S.decrement_onset(F.col("x")), 6).alias("decrement_onset"),
        F.round(S.sequence_effect_pct(F.col("x")), 6).alias("sequence_effect_pct"),
    )
