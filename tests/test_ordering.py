"""Ordered operators: the sliced plan against NumPy, with a key that holds most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oscilla.operators import ordering as O


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n))
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.05, None, key),
            "t": rng.permutation(n),
            "v": rng.integers(0, 40, n).astype(float),
        }
    )


def _frame(spark, data):
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), "k string, t long, v double")


def test_row_numbers(spark, data):
    got = O.number_rows(_frame(spark, data), ["k"], ["t"], "i").toPandas()
    want = data.sort_values("t").groupby("k", dropna=False).cumcount()
    merged = got.set_index("t")["i"].sort_index()
    assert merged.tolist() == want.rename(index=dict(zip(data.index, data["t"]))).sort_index().tolist()


def test_running_sum(spark, data):
    got = O.running_sum(_frame(spark, data), ["k"], ["t"], {"s": "v"}).toPandas().sort_values("t")
    want = data.sort_values("t").groupby("k", dropna=False)["v"].cumsum()
    assert np.allclose(got["s"], want)


def test_tie_ranks(spark, data):
    counts = _frame(spark, data).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = O.tie_ranks(counts, ["k"], "v", "n").select("k", "v", O.average_rank().alias("r")).toPandas()
    ranks = data.assign(r=data.groupby("k", dropna=False)["v"].rank())
    want = ranks.groupby(["k", "v"], dropna=False)["r"].first().reset_index()
    both = got.merge(want, on=["k", "v"])
    assert len(both) == len(want) and np.allclose(both["r_x"], both["r_y"])


@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles(spark, data, keys):
    got = O.exact_percentiles(_frame(spark, data), keys, "v", {"a": 0.1, "m": 0.5, "z": 0.95}).toPandas()
    groups = data.groupby("k", dropna=False) if keys else [(None, data)]
    assert len(got) == (data["k"].nunique(dropna=False) if keys else 1)
    for k, g in groups:
        row = got if not keys else got[got["k"].isna()] if pd.isna(k) else got[got["k"] == k]
        assert np.allclose(row[["a", "m", "z"]].to_numpy()[0], np.percentile(g["v"], [10, 50, 95]))


def test_recordings_are_whole(spark, data):
    got = O.to_recordings(_frame(spark, data), ["k"], ["t"])
    sizes = {r["k"]: (r["n"], r["last"]) for r in got.groupBy("k").agg(F.count("*").alias("n"), F.max("frame_idx").alias("last")).collect()}
    want = data.groupby("k", dropna=False).size()
    assert {n for n, _ in sizes.values()} == set(want) and all(last == n - 1 for n, last in sizes.values())
    assert got.select("clip").distinct().count() == 1


def test_long_gap_is_not_torn(spark):
    from oscilla.operators import sequence as S

    rows = [(1, i, None if 240 <= i <= 260 else float(i % 25)) for i in range(10_000)]
    df = O.to_recordings(spark.createDataFrame(rows, "video long, t long, v double"), ["video"], ["t"])
    gaps = S.occlusion_gaps(df, F.col("v").isNotNull(), 25.0).collect()
    assert len(gaps) == 1 and (gaps[0]["n_gaps"], gaps[0]["longest_gap_frames"]) == (1, 21)


def test_hot_key_spreads_over_slices(spark, data):
    hot = _frame(spark, data).filter("k = 'hot'")
    assert O.slice_by_order(hot, ["k"], ["t"], 8).select(O.SLICE).distinct().count() >= 4
