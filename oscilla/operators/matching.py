"""Detected against annotated extrema: greedy matching and set distances per recording."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.config import DEFAULTS
from oscilla.operators.borders import across, running, totals
from oscilla.operators.ordering import slice_by_order


def merge_extrema(df: DataFrame, keys: Sequence[str], times: str) -> DataFrame:
    """Union of the extrema lists that share a key, rounded to 6 digits, sorted, distinct."""
    return df.select(*keys, F.explode(times).alias("t")).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.round("t", 6))).alias(times)
    )


def inside_windows(
    points: DataFrame, windows: DataFrame, keys: Sequence[str], t: str = "t", start: str = "start", stop: str = "stop"
) -> DataFrame:
    """``points`` with ``inside``: whether an active window of the recording, ends included, holds the time.

    Any number of windows per recording, overlapping or not.  Where a recording has none, all its points count as
    inside.  No pair of point and window is formed: one pass over the points and the ends of windows in time
    order, cut by range, counts the windows that are open.  Windows without a start or an end are no windows, those that
    end before they start hold nothing; points without a time are not inside.
    """
    keys = list(keys)
    others = [c for c in points.columns if c not in (*keys, t)]
    known = windows.filter(F.col(start).isNotNull() & F.col(stop).isNotNull())
    lasting = (F.col(start) <= F.col(stop)).cast("long")
    # at equal times a window opens before the points and closes after them
    ends = F.array(
        F.struct(F.col(start).alias("_t"), F.lit(0).alias("_kind"), lasting.alias("_open")),
        F.struct(F.col(stop).alias("_t"), F.lit(2).alias("_kind"), (-lasting).alias("_open")),
    )
    edges = known.select(*keys, F.inline(ends)).withColumn("_row", F.lit(None).cast(points.select(F.struct(*others, F.lit(0))).schema[0].dataType))
    placed = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_open"), F.struct(*others, F.lit(0)).alias("_row"))
    merged = placed.unionByName(edges).withColumn("_o", F.struct("_t", "_kind"))
    counted = running(slice_by_order(merged, keys, ["_o"]), keys, "_o", {"_now": "_open"})
    counted = totals(counted, keys, {"_any": F.sum((F.col("_kind") != 1).cast("long"))})
    inside = (F.col("_t").isNotNull() & ((F.col("_any") == 0) | (F.col("_now") > 0))).alias("inside")
    return counted.filter("_kind = 1").select(*keys, F.col("_t").alias(t), *[F.col(f"_row.{c}").alias(c) for c in others], inside)


def sessions(points: DataFrame, keys: Sequence[str], gap: float, t: str = "t") -> DataFrame:
    """Spans (keys, ``start``, ``stop``) of points of which none is more than ``gap`` after the one before."""
    keys = list(keys)
    sliced = slice_by_order(points.select(*keys, t).filter(F.col(t).isNotNull()), keys, [t])

    def begun(rows: DataFrame, by: list[str]) -> DataFrame:
        before = F.lag(t).over(Window.partitionBy(*by).orderBy(t))
        return rows.withColumn("_new", F.coalesce(F.col(t) - before > gap, F.lit(True)).cast("long"))

    numbered = running(across(sliced, keys, t, begun, before=1), keys, t, {"_span": "_new"})
    return numbered.groupBy(*keys, "_span").agg(F.min(t).alias("start"), F.max(t).alias("stop")).drop("_span")


def match_times(det: np.ndarray, man: np.ndarray, tol: float) -> list[float]:
    """Errors of a one-to-one matching that takes the closest remaining pair first.

    The candidates of a point are the few neighbours within the tolerance, found by bisection.
    Equal distances go to the earlier detection, then the earlier annotation.
    """
    lo = np.searchsorted(man, det - tol, "left")
    hi = np.searchsorted(man, det + tol, "right")
    counts = np.maximum(hi - lo, 0)
    d = np.repeat(np.arange(len(det)), counts)
    offsets = np.arange(len(d)) - np.repeat(np.cumsum(counts) - counts, counts)
    m = np.repeat(lo, counts) + offsets
    error = np.abs(det[d] - man[m])
    free_d, free_m = np.ones(len(det), bool), np.ones(len(man), bool)
    matched = []
    for j in np.lexsort((m, d, error)):
        if free_d[d[j]] and free_m[m[j]] and error[j] <= tol:
            free_d[d[j]] = free_m[m[j]] = False
            matched.append(float(error[j]))
    return matched


def _matches(det: Column, man: Column, tol: float) -> Column:
    def run(detected: pd.Series, annotated: pd.Series) -> pd.Series:
        return pd.Series(
            [
                match_times(np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float)), tol)
                for a, b in zip(detected, annotated, strict=True)
            ]
        )

    return F.pandas_udf(run, "array<double>")(det, man)


def cycle_accuracy(
    df: DataFrame, keys: Sequence[str], tol: float = DEFAULTS.match_tolerance_s
) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 and timing error per recording (4 digits).

    ``df`` has one row per recording with the arrays ``det`` and ``man``; recordings without
    annotations are left out.
    """
    usable = df.filter(F.size("man") > 0).withColumn("_e", _matches(F.col("det"), F.col("man"), tol))
    tp = F.size("_e")
    nd, nm = F.size("det"), F.size("man")
    precision = F.coalesce(tp / F.nullif(nd, F.lit(0)), F.lit(0.0))
    recall = tp / nm
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    mean_error = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x) / F.nullif(tp, F.lit(0))
    return usable.select(
        *keys,
        nd.alias("n_detected"),
        nm.alias("n_manual"),
        tp.alias("tp"),
        (nd - tp).alias("fp"),
        (nm - tp).alias("fn"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        F.round(mean_error, 4).alias("mae_s"),
        F.round(nd / nm, 4).alias("count_ratio"),
        (nd - nm).alias("count_diff"),
    )


def accuracy_summary(per_video: DataFrame, fps: float = DEFAULTS.base_fps) -> DataFrame:
    return per_video.agg(
        F.count(F.lit(1)).alias("n_videos"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1", "mae_s", "count_ratio", "count_diff")],
        (F.avg("mae_s") * fps).alias("mean_mae_frames"),
    )


def worst_videos(per_video: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    return per_video.orderBy("f1", *keys).limit(n)


def set_distances(points: DataFrame, keys: Sequence[str], t: str = "t", side: str = "side") -> DataFrame:
    """Nearest-neighbour, Hausdorff and Wasserstein-1 distances of two point sets per recording.

    ``side`` is 'det' or 'man'.  All distances come from one sorted pass over the merged points:
    the nearest point of the other set is the last one before or the first one after, and the
    Wasserstein distance is the area between the two cumulative shares.  The points are cut by range.
    """
    is_det = F.col(side) == "det"
    placed = slice_by_order(points.withColumn("_o", F.struct(t, side)), keys, ["_o"])

    def neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_o")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        beyond = order.rowsBetween(0, Window.unboundedFollowing)
        here = F.when(side_of, F.col(t))
        return rows.withColumns(
            {f"{name}p": F.last(here, ignorenulls=True).over(upto), f"{name}n": F.first(here, ignorenulls=True).over(beyond)}
        )

    staged = placed
    for name, side_of in (("_d", is_det), ("_m", ~is_det)):
        staged = across(staged, keys, "_o", neighbours, near=side_of)

    def followed(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("_next", F.lead(t).over(Window.partitionBy(*by).orderBy("_o")))

    staged = across(staged, keys, "_o", followed, after=1).withColumns({"_isd": is_det.cast("long"), "_ism": (~is_det).cast("long")})
    staged = totals(running(staged, keys, "_o", {"_cd": "_isd", "_cm": "_ism"}), keys, {"_nd": F.sum("_isd"), "_nm": F.sum("_ism")})

    def nearest(before: str, after: str) -> Column:
        return F.least(F.col(t) - F.col(before), F.col(after) - F.col(t))

    gap = F.abs(
        F.col("_cd") / F.nullif(F.col("_nd"), F.lit(0)) - F.col("_cm") / F.nullif(F.col("_nm"), F.lit(0))
    )
    d2m = F.when(is_det, nearest("_mp", "_mn"))
    m2d = F.when(~is_det, nearest("_dp", "_dn"))
    agg = staged.groupBy(*keys).agg(
        F.max("_nd").alias("n_det"),
        F.max("_nm").alias("n_man"),
        F.avg(d2m).alias("nn_det_to_man"),
        F.avg(m2d).alias("nn_man_to_det"),
        F.greatest(F.max(d2m), F.max(m2d)).alias("hausdorff"),
        F.sum(gap * (F.col("_next") - F.col(t))).alias("_w"),
        F.avg(F.when(~is_det, F.col(t))).alias("_mean_man"),
    )
    both = F.col("n_det") > 0
    return agg.filter(F.col("n_man") > 0).select(
        *keys,
        F.when(both, F.col("nn_det_to_man")).alias("nn_det_to_man"),
        F.when(both, F.col("nn_man_to_det")).alias("nn_man_to_det"),
        F.when(both, (F.col("nn_det_to_man") + F.col("nn_man_to_det")) / 2.0).alias("sym_nn"),
        F.when(both, F.col("hausdorff")).alias("hausdorff"),
        F.when(both, F.col("_w")).otherwise(F.col("_mean_man")).alias("wasserstein"),
    )
