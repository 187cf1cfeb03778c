"""Zero-phase filtering of recordings of any length, slice by slice.

A recursive filter is a state that every sample maps by an affine map, and affine maps compose.  So
each slice of a recording runs from a zero state, which gives its map; the maps of a recording's slices,
one short row each, are folded in their order into the state at the start of every slice; and each slice
runs again from there.  The second pass goes the same way from the last slice to the first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oscilla.config import DEFAULTS, Settings
from oscilla.functions import dsp
from oscilla.operators.borders import totals
from oscilla.operators.ordering import SLICE, slice_by_order
from oscilla.session import durable

ARRAY = "array<double>"


def _extended(df: DataFrame, value: str, keys: Sequence[str], idx: str, pad: int, shortest: int) -> DataFrame:
    """Rows (keys, ``_j``, ``_v``, ``_real``) of the long recordings, point-reflected beyond both ends."""
    real = df.filter(F.col("_n") >= shortest).select(*keys, F.col(idx).cast("long").alias("_j"), F.col(value).cast("double").alias("_v"), "_n")

    def reflected(rows: DataFrame, at: str, mirror) -> DataFrame:
        near = F.array_sort(F.collect_list(F.struct(F.col(at).alias("d"), F.col("_v").alias("v"))))
        ends = rows.groupBy(*keys).agg(near.alias("_e"), F.max("_n").alias("_n"))
        turned = F.transform(
            F.slice("_e", 2, pad), lambda x: F.struct(mirror(x["d"]).alias("_j"), (2.0 * F.get("_e", F.lit(0))["v"] - x["v"]).alias("_v"))
        )
        return ends.select(*keys, F.explode(turned).alias("_x")).select(*keys, "_x._j", "_x._v", F.lit(False).alias("_real"))

    head = reflected(real.filter(F.col("_j") <= pad), "_j", lambda d: -d)
    last = real.withColumn("_d", F.col("_n") - 1 - F.col("_j"))
    tail = reflected(last.filter(F.col("_d") <= pad), "_d", lambda d: F.col("_n") - 1 + d)
    return real.select(*keys, "_j", "_v", F.lit(True).alias("_real")).unionByName(head).unionByName(tail)


def _pass(packed: DataFrame, x: str, out: str, keys: Sequence[str], edges: tuple[int, float, float], backward: bool) -> DataFrame:
    """Filter the array ``x`` of each slice, as if the slices of a recording were one signal."""
    by = [SLICE, *keys]
    steady = dsp.steady_state(dsp.butterworth(*edges))

    def end_state(signals: pd.Series) -> pd.Series:
        zero = np.zeros((len(steady), 1))
        return pd.Series([dsp.filter_from(edges, np.asarray(s, float)[:, None], zero)[1][:, 0] for s in signals])

    whole = Window.partitionBy(*keys)
    spanning = packed.withColumn("_spans", F.count(F.lit(1)).over(whole)).filter(F.col("_spans") > 1)
    maps = spanning.select(*by, F.size(x).alias("n"), F.get(x, F.lit(0)).alias("first"), F.pandas_udf(end_state, ARRAY)(x).alias("own"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(SLICE, ascending=not backward, ignore_index=True)
        state, starts = steady * group["first"][0], []
        for n, own in zip(group["n"], group["own"], strict=True):
            starts.append(state)
            state = dsp.carried(edges, int(n), state, np.asarray(own, float))
        return group[by].assign(_start=starts)

    types = dict(packed.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + f", _start {ARRAY}"
    # one row per slice and recording that crosses a border: at most two per slice
    starts = durable(maps.groupBy(*keys).applyInPandas(fold, schema))
    match = F.col(SLICE) == F.col("_cs")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    named = starts.select(F.col(SLICE).alias("_cs"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_start")

    def run(signals: pd.Series, begins: pd.Series) -> pd.Series:
        done = []
        for s, begin in zip(signals, begins, strict=True):
            signal = np.asarray(s, float)
            state = steady * signal[0] if begin is None else np.asarray(begin, float)
            done.append(dsp.filter_from(edges, signal[:, None], state[:, None])[0][:, 0])
        return pd.Series(done)

    joined = packed.join(F.broadcast(named), match, "left")
    return joined.select(*packed.columns, F.pandas_udf(run, ARRAY)(x, "_start").alias(out))


def zero_phase(
    df: DataFrame,
    value: str,
    out: str,
    fps: float,
    highpass_hz: float,
    keys: Sequence[str] = ("video", "clip"),
    idx: str = "frame_idx",
    settings: Settings = DEFAULTS,
    slices: int | None = None,
) -> DataFrame:
    """(keys, ``idx``, ``out``): ``value`` filtered forward and backward without a shift in time.

    ``idx`` counts the samples of a recording from 0 without holes, and no sample is missing (see
    ``interpolate_gaps``).  Recordings that are too short for the filter stay as they are.
    """
    keys = list(keys)
    edges = dsp.band_edges(fps, settings.cutoff_hz, highpass_hz, settings.filter_order)
    shortest = dsp.shortest_filtered(settings.filter_order)
    counted = durable(totals(df, keys, {"_n": F.count(F.lit(1))}).select(*keys, idx, value, "_n"))
    sliced = slice_by_order(_extended(counted, value, keys, idx, dsp.padding(edges), shortest), keys, ["_j"], slices)
    samples = F.array_sort(F.collect_list(F.struct("_j", "_v", "_real")))
    packed = sliced.groupBy(SLICE, *keys).agg(samples.alias("_s")).withColumn("_x", F.col("_s._v"))
    forward = durable(_pass(durable(packed), "_x", "_f", keys, edges, backward=False))
    turned = forward.select(SLICE, *keys, "_s", F.reverse("_f").alias("_r"))
    both = _pass(turned, "_r", "_b", keys, edges, backward=True)
    rows = F.explode(F.arrays_zip(F.col("_s").alias("s"), F.reverse("_b").alias("y"))).alias("_p")
    done = both.select(*keys, rows).filter("_p.s._real").select(*keys, F.col("_p.s._j").alias(idx), F.col("_p.y").alias(out))
    short = counted.filter(F.col("_n") < shortest).select(*keys, F.col(idx).cast("long").alias(idx), F.col(value).cast("double").alias(out))
    return done.unionByName(short)
