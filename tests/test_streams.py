"""Streams against batch results: any cut into micro-batches and any arrival within the lateness gives the same."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oscilla.operators import sequence
from oscilla.streaming import ordered, twins

SCHEMA = "video string, ts timestamp, frame_idx long, v double"


def samples(seed):
    rng = np.random.default_rng(seed)
    parts = []
    for name, n in (("a", 150), ("b", 60), (None, 20)):
        walk = np.cumsum(rng.normal(0, 1.2, n))
        v = np.where(rng.random(n) < 0.15, np.nan, (walk + np.pi) % (2 * np.pi) - np.pi)
        parts.append(pd.DataFrame({"video": name, "frame_idx": np.arange(n), "v": v}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["video"] = pdf["video"].astype(object).where(pdf["video"].notna(), None)
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["frame_idx"] * 40, unit="ms")
    # arrival is at most 20 frames (0.8 s) out of order
    return pdf.iloc[np.argsort(pdf["frame_idx"] + rng.uniform(0, 20, len(pdf)), kind="stable")]


def arrive(spark, pdf, folder, cuts):
    flush = pd.DataFrame({"video": ["end"], "frame_idx": [0], "v": [0.0], "ts": [pd.Timestamp("2024-01-01 01:00")]})
    for part in [*np.array_split(np.arange(len(pdf)), cuts), None]:
        rows = flush if part is None else pdf.iloc[part]
        values = [(r.video, r.ts.to_pydatetime(), int(r.frame_idx), None if math.isnan(r.v) else float(r.v)) for r in rows.itertuples()]
        spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return twins.stream_table(spark, folder, SCHEMA, files_per_batch=1)


def result(spark, stream, tmp_path, columns):
    twins.append_log(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(200)
    rows = spark.read.parquet(str(tmp_path / "o")).filter("video IS NULL OR video <> 'end'").select("video", "frame_idx", *columns).collect()
    return {(r[0], r[1]): tuple(r)[2:] for r in rows}, len(rows)


@pytest.mark.parametrize("cuts", [1, 6])
def test_running_rotation(spark, tmp_path, cuts):
    pdf = samples(1)
    stream = arrive(spark, pdf, str(tmp_path / "s"), cuts)
    got, n = result(spark, ordered.running_rotation(stream, "video", "ts", "frame_idx", "v", "1 second"), tmp_path, ["unwrapped", "amplitude", "total"])
    want = {}
    for name, part in pdf.groupby("video", dropna=False):
        last, at, low, high, total = None, 0.0, 0.0, 0.0, 0.0
        for r in part.sort_values("frame_idx").itertuples():
            if last is not None and not math.isnan(r.v):
                turn = math.atan2(math.sin(r.v - last), math.cos(r.v - last))
                at, total = at + turn, total + abs(turn)
                low, high = min(low, at), max(high, at)
            last = None if math.isnan(r.v) else r.v
            want[(None if pd.isna(name) else name, r.frame_idx)] = (at, high - low, total)
    assert n == len(pdf) and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_one_euro_stream_equals_batch(spark, tmp_path):
    pdf = samples(2)
    stream = arrive(spark, pdf, str(tmp_path / "s"), 5)
    got, n = result(spark, ordered.one_euro_stream(stream, "video", "ts", "frame_idx", "v", "smooth", 25.0, "1 second"), tmp_path, ["smooth"])
    still = spark.read.schema(SCHEMA).parquet(str(tmp_path / "s")).filter("video IS NULL OR video <> 'end'")
    batch = sequence.one_euro(still, "v", "smooth", 25.0, keys=["video"])
    want = {(r["video"], r["frame_idx"]): r["smooth"] for r in batch.collect()}
    assert n == len(want) and got.keys() == want.keys()
    assert all((want[k] is None) == (got[k][0] is None) and (want[k] is None or abs(want[k] - got[k][0]) < 1e-12) for k in want)


def seconds(spark, folder, *batches):
    for batch in batches:
        spark.createDataFrame([("a", s, float(v)) for s, v in batch], "video string, s long, v double").select(
            "video", F.timestamp_seconds("s").alias("ts"), F.col("s").alias("frame_idx"), "v"
        ).coalesce(1).write.mode("append").parquet(folder)
    return twins.stream_table(spark, folder, SCHEMA, files_per_batch=1)


def test_samples_after_their_time_are_dropped(spark, tmp_path):
    # a batch works with the watermark of the batches before: 103 comes when 200 - 10 has been worked off
    stream = seconds(spark, str(tmp_path / "s"), [(101, 0.1), (102, 0.2)], [(200, 0.3)], [(201, 0.3)], [(103, 3.0), (260, 0.4)], [(400, 0.5)])
    got, _ = result(spark, ordered.running_rotation(stream, "video", "ts", "frame_idx", "v", "10 seconds"), tmp_path, ["unwrapped"])
    assert sorted(k[1] for k in got) == [101, 102, 200, 201, 260]
    assert abs(got[("a", 260)][0] - 0.3) < 1e-12


def test_tumbling_and_sliding_windows(spark, tmp_path):
    batches = ([(100, 1), (109, 3), (112, 5)], [(105, 8), (131, 2)], [(133, 4)], [(104, 99), (121, 7)], [(500, 0)])
    stream = seconds(spark, str(tmp_path / "s"), *batches)
    names = ["start", "stop", "n", "mean", "low", "high"]

    def run(out, slide=None):
        windows = ordered.windowed_summary(stream, ["video"], "ts", "v", "10 seconds", "15 seconds", slide)
        twins.append_log(windows, str(tmp_path / out), str(tmp_path / f"{out}-c")).awaitTermination(200)
        rows = spark.read.parquet(str(tmp_path / out)).selectExpr("unix_seconds(start)", "unix_seconds(stop)", *names[2:])
        return sorted(tuple(r) for r in rows.collect())

    # 105 arrives out of order but in time, 104 a batch after the watermark (131 - 15) has passed the end of its window
    assert run("tumbling") == [(100, 110, 3, 4.0, 1.0, 8.0), (110, 120, 1, 5.0, 5.0, 5.0), (120, 130, 1, 7.0, 7.0, 7.0), (130, 140, 2, 3.0, 2.0, 4.0)]
    kept = [(100, 1), (109, 3), (112, 5), (105, 8), (131, 2), (133, 4), (121, 7)]
    want = []
    for start in range(90, 140, 5):
        inside = [v for s, v in kept if start <= s < start + 10]
        if inside:
            want.append((start, start + 10, len(inside), sum(inside) / len(inside), float(min(inside)), float(max(inside))))
    assert run("sliding", "5 seconds") == want


def test_last_write_wins(spark, tmp_path):
    schema = "k string, version long, v string"
    src, table = str(tmp_path / "s"), str(tmp_path / "t")

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)

    def merge(checkpoint):
        stream = twins.stream_table(spark, src, schema, files_per_batch=1)
        ordered.merge_log(stream, table, str(tmp_path / checkpoint), ["k"], "version", fold_every=2).awaitTermination(200)
        return {tuple(r) for r in ordered.latest(spark, table, ["k"], "version").collect()}

    feed(("a", 1, "x"), ("a", 3, "y"), ("b", 1, "p"), (None, None, "n"))
    feed(("a", 2, "late"), ("b", 1, "q"))
    pick = {("a", 3, "y"), ("b", 1, "q"), (None, None, "n")}
    assert merge("c1") == pick
    feed(("b", None, "older"), ("c", 5, "z"))
    assert merge("c1") == pick | {("c", 5, "z")}
    # all batches once more under a new checkpoint: same numbers, same table
    assert merge("c2") == pick | {("c", 5, "z")}
