"""Frame-ordered operators on recordings, as windows and array expressions.

All functions take the keys of a recording (``video``, ``clip``).  Frames that carry a slice number (see
:func:`to_recordings`) are handled slice by slice, with the rows of neighbouring slices that a window
needs and carried sums, so a recording of any length spreads over many tasks.  Without one, a
hash exchange on the keys serves every window a query stacks up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from oscilla.config import DEFAULTS, Settings
from oscilla.operators.borders import across, running, totals, with_same_keys
from oscilla.operators.cohort import null_safe_join
from oscilla.operators.ordering import SLICE, exact_percentiles

KEYS = ("video", "clip")
TWO_PI = 2.0 * math.pi


def _w(keys: Sequence[str], idx: str = "frame_idx") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(idx)


def _whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    Catalyst re-evaluates an expression for every element of a lambda that mentions it; binding it
    as the variable of a one-element transform computes it once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_median(values: Column) -> Column:
    """Median of a short array; NULL for an empty one."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def pearson(x: Column, y: Column) -> Column:
    """Correlation of complete pairs as an aggregate; NULL without spread."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.covar_pop(px, py) / F.nullif(F.stddev_pop(px) * F.stddev_pop(py), F.lit(0.0))


def pack(df: DataFrame, keys: Sequence[str], idx: str, columns: Sequence[str]) -> DataFrame:
    """One row per recording with its samples as an ordered array of structs (bounded)."""
    return df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(idx, *columns))).alias("samples")
    )


# gaps and smoothing


def trim_to_valid(
    df: DataFrame, value: str, keys: Sequence[str] = KEYS, idx: str = "frame_idx"
) -> DataFrame:
    """Frames from the first to the last valid sample, missing ones in between included.

    The limits are one row per recording, combined before the shuffle; recordings without a valid sample go.
    """
    limits = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    staged = null_safe_join(df, limits, keys)
    return staged.filter(F.col(idx).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def interpolate_gaps(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = KEYS, idx: str = "frame_idx"
) -> DataFrame:
    """Linear interpolation over missing samples, ends held flat; all zero below two samples."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))

    def neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
        w = _w(by, idx)
        before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return rows.withColumns({"_b": before, "_a": after})

    counted = totals(df, keys, {"_n": F.count(value)})
    staged = across(counted, keys, idx, neighbours, near=F.col(value).isNotNull())
    share = (F.col(idx) - F.col("_b.i")) / F.nullif(F.col("_a.i") - F.col("_b.i"), F.lit(0))
    inner = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share
    filled = F.coalesce(F.col(value), inner, F.col("_b.v"), F.col("_a.v"))
    return staged.withColumn(out, F.when(F.col("_n") < 2, 0.0).otherwise(filled)).drop("_b", "_a", "_n")


def hampel(
    df: DataFrame,
    value: str,
    out: str,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Replace samples far from the local median (in scaled MADs of the raw window)."""
    half = settings.hampel_window // 2

    def patched(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("_patch", F.collect_list(value).over(_w(by, idx).rowsBetween(-half, half)))

    def cleaned(med: Column) -> Column:
        mad = array_median(F.transform("_patch", lambda x: F.abs(x - med)))
        far = F.abs(F.col(value) - med) > settings.hampel_sigma * 1.4826 * mad
        return F.when(far, med).otherwise(F.col(value))

    staged = across(df, keys, idx, patched, before=half, after=half)
    return staged.withColumn(out, let(array_median(F.col("_patch")), cleaned)).drop("_patch")


def moving_average(
    df: DataFrame, columns: Sequence[str], window: int, keys: Sequence[str] = KEYS, idx: str = "frame_idx"
) -> DataFrame:
    """Centred mean over the neighbours that exist within the frame range."""
    if window <= 1:
        return df.withColumns({f"{c}_smooth": F.col(c) for c in columns})
    half = (window if window % 2 else window + 1) // 2

    def smoothed(rows: DataFrame, by: list[str]) -> DataFrame:
        span = _w(by, idx).rangeBetween(-half, half)
        return rows.withColumns({f"{c}_smooth": F.avg(c).over(span) for c in columns})

    return across(df, keys, idx, smoothed, before=half, after=half)


def one_euro(
    df: DataFrame,
    value: str,
    out: str,
    fps: float,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One-Euro filter per recording; gaps of two or more missing samples restart it.

    A restart forgets everything, so recordings are cut there into stretches, numbered by a running sum.
    A stretch is a recursion: its samples pass through one task as a sorted stream, which holds a batch and
    the state of the filter, however long the stretch is.  The derivative uses the previous *filtered*
    value.  ``idx`` counts frames without holes.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())

    def begun(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("_fresh", F.coalesce(F.col(idx) - F.lag(idx).over(_w(by, idx)) > 2, F.lit(True)).cast("int"))

    stretches = running(across(present, keys, idx, begun, before=1), keys, idx, {"_stretch": "_fresh"})
    slim = stretches.select(*keys, F.col("_stretch").cast("long").alias("_stretch"), idx, F.col(value).cast("double").alias("_v"))
    dt = 1.0 / max(fps, 1.0)

    def alpha(cutoff: float) -> float:
        return 1.0 / (1.0 + 1.0 / (TWO_PI * cutoff) / dt)

    a_d, low, beta = alpha(settings.one_euro_d_cutoff), settings.one_euro_min_cutoff, settings.one_euro_beta
    names = [*keys, idx, out]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        x = dx = 0.0
        for batch in batches:
            ys = []
            for *key, v in batch[[*keys, "_stretch", "_v"]].itertuples(index=False, name=None):
                if key == last:
                    dx = a_d * ((v - x) / dt) + (1.0 - a_d) * dx
                    a = alpha(low + beta * abs(dx))
                    x = a * v + (1.0 - a) * x
                else:
                    last, x, dx = key, v, 0.0
                ys.append(x)
            yield batch.assign(**{out: ys})[names]

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, idx]) + f", `{out}` double"
    ordered = slim.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", idx)
    missing = df.filter(F.col(value).isNull()).select(*keys, idx, F.lit(None).cast("double").alias(out))
    return ordered.mapInPandas(smooth, schema).unionByName(missing)


# angles


def wrap_to_pi(angle: Column) -> Column:
    return F.pmod(angle + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def reject_spikes(
    df: DataFrame,
    angle: str,
    out: str,
    fps: float,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """NULL a sample that jumps from both valid neighbours by more than the limit."""
    limit = settings.spike_jump_rad * settings.base_fps / fps
    valid = F.col(angle).isNotNull()

    def neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by, valid).orderBy(idx)
        return rows.withColumns({"_p": F.lag(angle).over(w), "_n": F.lead(angle).over(w)})

    def arc(other: Column) -> Column:
        d = F.abs(F.col(angle) - other)
        return F.least(d, F.lit(TWO_PI) - d)

    staged = across(df, keys, idx, neighbours, near=valid)
    spike = valid & (arc(F.col("_p")) > limit) & (arc(F.col("_n")) > limit)
    return staged.withColumn(
        out, F.when(~F.coalesce(spike, F.lit(False)), F.col(angle))
    ).drop("_p", "_n")


def unwrap(
    df: DataFrame,
    angle: str,
    out: str,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    axial: bool = False,
) -> DataFrame:
    """Phase unwrap across gaps: every step is corrected by its whole number of turns.

    ``axial`` treats theta and theta + pi as the same pose (double, unwrap, halve).
    """
    factor = 2.0 if axial else 1.0
    scaled = F.col(angle) * factor
    valid = F.col(angle).isNotNull()

    def turned(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by, valid).orderBy(idx)
        step = F.rint((scaled - F.lag(scaled).over(w)) / TWO_PI)
        return rows.withColumn("_turns", F.when(valid, F.coalesce(step, F.lit(0.0))).otherwise(0.0))

    staged = running(across(df, keys, idx, turned, near=valid), keys, idx, {"_total": "_turns"})
    return staged.withColumn(
        out, F.when(valid, (scaled - TWO_PI * F.col("_total")) / factor)
    ).drop("_turns", "_total")


# extrema and cycles


def _with_neighbours(df: DataFrame, value: str, keys: Sequence[str], idx: str) -> DataFrame:
    """Add the sample before (``_p``) and after (``_n``)."""

    def add(rows: DataFrame, by: list[str]) -> DataFrame:
        w = _w(by, idx)
        return rows.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)})

    return across(df, keys, idx, add, before=1, after=1)


def gradient(
    df: DataFrame, value: str, out: str, fps: float, keys: Sequence[str] = KEYS, idx: str = "frame_idx"
) -> DataFrame:
    """Central differences, one-sided at the ends."""
    staged = _with_neighbours(df, value, keys, idx)
    rate = (
        F.when(F.col("_p").isNull(), F.col("_n") - F.col(value))
        .when(F.col("_n").isNull(), F.col(value) - F.col("_p"))
        .otherwise((F.col("_n") - F.col("_p")) / 2.0)
    )
    return staged.withColumn(out, rate * fps).drop("_p", "_n")


def zero_crossing_extrema(
    df: DataFrame,
    signal: str,
    centred: str,
    min_frames: int,
    max_frames: int,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
) -> DataFrame:
    """Half cycles between zero crossings; the extremum of ``signal`` in each of them.

    A half cycle runs from the last sample before one crossing to the last sample before the next,
    both included; exact zeros count as positive.
    """
    sign = F.when(F.col(centred) < 0, -1).otherwise(1)

    def marked(rows: DataFrame, by: list[str]) -> DataFrame:
        signed = rows.withColumn("_sign", sign)
        crossing = F.lead("_sign").over(_w(by, idx)) != F.col("_sign")
        return signed.withColumn("_end", F.coalesce(crossing, F.lit(False)).cast("int"))

    parts = running(across(df, keys, idx, marked, after=1), keys, idx, {"_part": "_end"}, inclusive=False)
    # the closing sample of part p is also the opening sample of part p + 1
    both = parts.withColumn(
        "_half",
        F.explode(
            F.when(F.col("_end") == 1, F.array(F.col("_part"), F.col("_part") + 1)).otherwise(
                F.array("_part")
            )
        ),
    )
    group = both.groupBy(*keys, "_half").agg(
        F.min(idx).alias("start"),
        F.max(idx).alias("stop"),
        F.max_by(F.col("_sign"), F.col(idx)).alias("etype"),
        F.count_if(F.col("_end") == 1).alias("_ends"),
        F.max(signal).alias("_hi"),
        F.min(signal).alias("_lo"),
        F.max_by(F.col(idx), F.struct(F.col(signal), -F.col(idx))).alias("_at_hi"),
        F.min_by(F.col(idx), F.struct(F.col(signal), F.col(idx))).alias("_at_lo"),
    )
    span = F.col("stop") - F.col("start")
    bounded = (F.col("_half") >= 1) & (F.col("_ends") == 2)
    return group.filter(bounded & (span >= min_frames) & (span <= max_frames)).select(
        *keys,
        "etype",
        F.when(F.col("etype") == 1, F.col("_at_hi")).otherwise(F.col("_at_lo")).alias(idx),
        F.when(F.col("etype") == 1, F.col("_hi")).otherwise(F.col("_lo")).alias("height"),
    )


def alternate(
    df: DataFrame,
    etype: str = "etype",
    height: str = "height",
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
) -> DataFrame:
    """Collapse runs of equal types to their extreme sample; the first of equals wins."""

    def begun(rows: DataFrame, by: list[str]) -> DataFrame:
        before = F.lag(etype).over(_w(by, idx))
        return rows.withColumn("_fresh", (before.isNull() | (before != F.col(etype))).cast("int"))

    runs = running(across(df, keys, idx, begun, before=1), keys, idx, {"_run": "_fresh"})
    best = F.struct((F.col(etype) * F.col(height)).alias("h"), (-F.col(idx)).alias("i"))
    return runs.groupBy(*keys, "_run").agg(
        F.max_by(F.col(etype), best).alias(etype),
        F.max_by(F.col(height), best).alias(height),
        F.max_by(F.col(idx), best).alias(idx),
    ).drop("_run")


def parabolic_vertex(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = KEYS, idx: str = "frame_idx"
) -> DataFrame:
    """Vertex through a sample and its neighbours, the sample itself where that fails."""
    staged = _with_neighbours(df, value, keys, idx)
    p, c, n = F.col("_p"), F.col(value), F.col("_n")
    denom = p - 2.0 * c + n
    vertex = c - 0.25 * (p - n) * (0.5 * (p - n) / F.nullif(denom, F.lit(0.0)))
    flat = p.isNull() | n.isNull() | (F.abs(denom) < 1e-12)
    wrong_peak = (c >= p) & (c >= n) & (vertex < c)
    wrong_valley = (c <= p) & (c <= n) & (vertex > c)
    return staged.withColumn(
        out, F.when(flat | wrong_peak | wrong_valley, c).otherwise(vertex)
    ).drop("_p", "_n")


def integral_amplitude(
    velocity: DataFrame,
    extrema: DataFrame,
    rate: str,
    fps: float,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
) -> DataFrame:
    """Mean trapezoid integral of |velocity| between consecutive extrema."""
    marks = extrema.select(*keys, idx, F.lit(1).alias("_mark"))
    joined = velocity.join(marks, [*keys, idx], "left").withColumn("_mark", F.coalesce("_mark", F.lit(0)))

    def areas(rows: DataFrame, by: list[str]) -> DataFrame:
        before = F.lag(rate).over(_w(by, idx))
        return rows.withColumn("_area", (F.abs(F.col(rate)) + F.abs(before)) / 2.0 / fps)

    counted = totals(across(joined, keys, idx, areas, before=1), keys, {"_marks": F.sum("_mark")})
    staged = running(counted, keys, idx, {"_half": "_mark"}, inclusive=False)
    # part 0 lies before the first extremum, the last part after the last one
    inside = (F.col("_half") >= 1) & (F.col("_half") < F.col("_marks"))
    halves = staged.filter(inside).groupBy(*keys, "_half").agg(F.sum("_area").alias("excursion"))
    return halves.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 2, F.avg("excursion")).alias("integral_amplitude")
    )


# sessions and gaps


def activity_segment(
    df: DataFrame,
    rate: str,
    fps: float,
    keys: Sequence[str] = ("video",),
    idx: str = "frame_idx",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """First sustained activity of a recording: [start, stop] frames, at most ``max_task_s``.

    ``rate`` is the angular speed of tracked frames.  It is box-smoothed over the frame axis
    (untracked frames count as still), thresholded against a percentile, and islands closer than
    the merge gap become one segment.
    """
    window = max(1, int(settings.activity_window_s * fps))
    window += 1 - window % 2
    half = window // 2
    w = _w(keys, idx)
    smooth = F.sum(rate).over(w.rangeBetween(-half, half)) / float(window)
    staged = df.withColumn("_smooth", smooth)
    reference = F.percentile("_smooth", settings.activity_percentile / 100.0).over(_whole(keys))
    staged = staged.withColumns({"_ref": reference, "_n": F.count(F.lit(1)).over(_whole(keys))})
    active = staged.filter(
        (F.col("_n") >= 10)
        & (F.col("_ref") >= 1e-6)
        & (F.col("_smooth") >= settings.activity_ratio * F.col("_ref"))
    )
    gap = max(1, int(settings.merge_gap_s * fps))
    previous = F.lag(idx).over(w)
    fresh = (previous.isNull() | (F.col(idx) - previous > gap)).cast("int")
    islands = active.withColumn("_fresh", fresh).withColumn(
        "_seg", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    segments = islands.groupBy(*keys, "_seg").agg(F.min(idx).alias("s"), F.max(idx).alias("e"))
    length = F.col("e") - F.col("s") + 1
    enough = (length >= int(settings.min_task_s * fps)).cast("int")
    # earliest segment that is long enough, else the longest (the earliest of equals)
    preference = F.struct(
        (-enough).alias("a"), F.when(enough == 1, 0).otherwise(-length).alias("b"), F.col("s").alias("c")
    )
    return segments.groupBy(*keys).agg(F.min_by(F.struct("s", "e"), preference).alias("_best")).select(
        *keys,
        F.col("_best.s").alias("ps_start"),
        F.least(
            F.col("_best.e"), F.col("_best.s") + int(settings.max_task_s * fps) - 1
        ).alias("ps_end"),
    )


def occlusion_gaps(
    df: DataFrame, detected: Column, fps: float, keys: Sequence[str] = KEYS, idx: str = "frame_idx"
) -> DataFrame:
    """Runs of undetected frames between the first and last detection of a recording."""
    hits = df.filter(detected).select(*keys, idx, *[c for c in (SLICE,) if c in df.columns])

    def stepped(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("_gap", F.col(idx) - F.lag(idx).over(_w(by, idx)) - 1)

    steps = across(hits, keys, idx, stepped, before=1)
    gap = F.when(F.col("_gap") > 0, F.col("_gap"))
    window_len = F.max(idx) - F.min(idx) + 1
    return steps.groupBy(*keys).agg(
        (F.count(F.lit(1)) / window_len).alias("detection_rate"),
        F.count(gap).alias("n_gaps"),
        F.coalesce(F.max(gap), F.lit(0)).alias("longest_gap_frames"),
        (F.coalesce(F.max(gap), F.lit(0)) / max(fps, 1.0)).alias("longest_gap_s"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_gap_frames"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("total_gap_frames"),
        (F.coalesce(F.sum(gap), F.lit(0)) / window_len).alias("gap_fraction"),
    )


def nearest_tracked(
    df: DataFrame, tracked: Column, columns: Sequence[str], keys: Sequence[str] = KEYS, idx: str = "frame_idx"
) -> DataFrame:
    """Nearest tracked frame of each frame; of two equally near ones the earlier."""
    here = F.when(tracked, F.struct(F.col(idx).alias("i"), *columns))

    def neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
        w = _w(by, idx)
        before = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return rows.withColumns({"_b": before, "_a": after})

    staged = across(df, keys, idx, neighbours, near=tracked)
    nearer = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).otherwise(
        F.when(F.col(idx) - F.col("_b.i") <= F.col("_a.i") - F.col(idx), F.col("_b")).otherwise(F.col("_a"))
    )
    return staged.withColumn("nearest", nearer).drop("_b", "_a")


# features over the ordered cycles of a recording


def decrement_onset(values: Column) -> Column:
    """Where sustained decrement starts, in [0, 1]; 1 means none, 0.85 only a gradual one."""
    n = F.size(values)

    def at(i: Column) -> Column:
        return F.get(values, i.cast("int"))

    def smoothed(i: Column) -> Column:
        left = at(F.abs(i - 1))
        right = at(F.when(i + 1 < n, i + 1).otherwise(2 * n - 3 - i))
        return (left + at(i) + right) / 3.0

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def slope_pct(a: Column) -> Column:
        m = F.size(a)
        centre = (m - 1) / 2.0
        weighted = F.aggregate(
            F.transform(a, lambda x, i: (i - centre) * x), F.lit(0.0), lambda s, x: s + x
        )
        return weighted / (m * (m * m - 1) / 12.0) / mean(a) * 100.0

    win = F.least(F.greatest(F.lit(3), F.floor(n / 3).cast("int")), n - 1)

    def onset(smooth: Column) -> Column:
        def falls(i: Column) -> Column:
            return let(
                F.slice(smooth, i + 1, win), lambda seg: (mean(seg) >= 1e-6) & (slope_pct(seg) < -2.0)
            )

        first = F.array_min(F.filter(F.sequence(F.lit(0), n - win), falls))
        found = F.coalesce(first / F.greatest(n - 1, F.lit(1)), F.lit(0.85))
        return F.when(mean(smooth) >= 1e-6, F.when(slope_pct(smooth) > -1.0, 1.0).otherwise(found))

    smooth = F.transform(F.sequence(F.lit(0), n - 1), smoothed)
    return F.when(n >= 3, let(smooth, onset))


def sequence_effect_pct(values: Column, split: float = DEFAULTS.decrement_split) -> Column:
    """Early-to-late decrement in percent of the early median; NULL below four values."""
    n = F.size(values)
    win = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(n * split).cast("int")))
    early = array_median(F.slice(values, 1, win))
    late = array_median(F.slice(values, n - win + 1, win))
    return F.when((n >= 4) & (early > 1e-6), (early - late) / early * 100.0)


def clip_slope(slope: Column, mean: Column, floor: float) -> Column:
    pct = slope / mean * 100.0
    return F.when(mean > floor, F.greatest(F.lit(-50.0), F.least(F.lit(50.0), pct)))


def cycle_features(
    df: DataFrame,
    amplitude: str = "amplitude",
    interval: str = "interval_s",
    velocity: str = "peak_velocity",
    keys: Sequence[str] = KEYS,
    idx: str = "cycle_no",
    start: Column | None = None,
) -> DataFrame:
    """Amplitude, timing and velocity features from the cycle rows of each recording.

    ``start`` is the start time of a cycle; without it cycles follow one another without gaps.
    """
    timed = df.withColumn("_t", start) if start is not None else running(df, keys, idx, {"_t": interval}, inclusive=False)
    n = F.count(F.lit(1))
    cycle_no = F.col(idx).cast("double")
    agg = timed.groupBy(*keys).agg(
        n.alias("total_cycles"),
        F.avg(amplitude).alias("mean_amplitude"),
        F.stddev_pop(amplitude).alias("_sd_a"),
        (F.lit(1.0) / F.avg(interval)).alias("mean_frequency"),
        F.avg(interval).alias("avg_cycle_duration"),
        F.stddev_pop(interval).alias("_sd_i"),
        F.when(n >= 2, F.stddev_samp(interval)).alias("_ss_i"),
        F.when(n >= 3, F.regr_slope(F.col(amplitude), F.col("_t"))).alias("raw_amp_slope"),
        F.when(n >= 2, F.regr_slope(F.col(amplitude), F.col("_t"))).alias("_slope_a"),
        F.when(n >= 3, F.regr_slope(F.col(interval), cycle_no)).alias("raw_cycle_duration_slope"),
        F.avg(velocity).alias("mean_peak_velocity"),
        F.when(n >= 2, F.stddev_samp(velocity)).alias("_ss_v"),
        F.when(n >= 3, F.regr_slope(F.col(velocity), cycle_no)).alias("raw_velocity_slope"),
        F.when(
            (n >= 4) & (F.stddev_pop(amplitude) > 1e-9) & (F.stddev_pop(velocity) > 1e-9),
            pearson(F.col(amplitude), F.col(velocity)),
        ).alias("amp_vel_coupling"),
    )

    def cv(sd: str, mean: str) -> Column:
        return F.when(F.col(mean) > 1e-9, F.col(sd) / F.col(mean) * 100.0)

    return agg.select(
        *keys,
        "total_cycles",
        "mean_amplitude",
        F.coalesce(cv("_sd_a", "mean_amplitude"), F.lit(0.0)).alias("amplitude_cv"),
        "mean_frequency",
        "avg_cycle_duration",
        F.coalesce(cv("_sd_i", "avg_cycle_duration"), F.lit(0.0)).alias("rhythm_cv"),
        cv("_ss_i", "avg_cycle_duration").alias("cycle_duration_cv"),
        "raw_amp_slope",
        clip_slope(F.col("_slope_a"), F.col("mean_amplitude"), 1.0).alias("norm_decrement_slope"),
        "raw_cycle_duration_slope",
        clip_slope(F.col("raw_cycle_duration_slope"), F.col("avg_cycle_duration"), 1e-9).alias("norm_ti_slope"),
        F.col("mean_peak_velocity").alias("peak_velocity"),
        cv("_ss_v", "mean_peak_velocity").alias("peak_velocity_cv"),
        "raw_velocity_slope",
        clip_slope(F.col("raw_velocity_slope"), F.col("mean_peak_velocity"), 1e-9).alias(
            "norm_velocity_decrement_slope"
        ),
        "amp_vel_coupling",
    )


def interruptions(
    df: DataFrame, interval: str, keys: Sequence[str] = KEYS, settings: Settings = DEFAULTS
) -> DataFrame:
    """Hesitations, arrests and pause burden of the half-cycle intervals of each recording."""
    clean = totals(df.filter(F.col(interval) > 1e-6), keys, {"_n": F.count(F.lit(1))})
    if SLICE in df.columns:
        middle = exact_percentiles(clean, keys, interval, {"_med": 0.5})
        staged = with_same_keys(clean, keys, middle)
    else:
        staged = clean.withColumn("_med", F.percentile(interval, 0.5).over(_whole(keys)))
    enough = F.col("_n") >= 2
    arrest = enough & (
        F.col(interval) > F.greatest(settings.arrest_ratio * F.col("_med"), F.lit(settings.arrest_floor_s))
    )
    pause = arrest | (
        enough
        & (
            F.col(interval)
            > F.greatest(settings.hesitation_ratio * F.col("_med"), F.lit(settings.hesitation_floor_s))
        )
    )
    paused = F.when(pause, F.col(interval))
    return staged.groupBy(*keys).agg(
        F.count_if(pause & ~arrest).alias("num_hesitations"),
        F.count_if(arrest).alias("num_arrests"),
        F.count_if(enough & (F.col(interval) > 2.0 * F.col("_med"))).alias("num_interruptions"),
        F.coalesce(F.max(paused), F.lit(0.0)).alias("max_pause_duration_s"),
        F.coalesce(
            F.when(F.max(F.col("_n")) >= 2, F.sum(paused) / F.sum(interval)), F.lit(0.0)
        ).alias("pause_time_ratio"),
    )
