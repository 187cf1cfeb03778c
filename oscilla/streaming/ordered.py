"""Recursions over streams whose rows arrive out of order, event-time windows, and a last-write-wins table.

A recursion (running rotation, One-Euro filter) needs its samples in order.  Rows wait in the state of their key
until the watermark has passed them; then they are taken in the order of (time, index), so how the input was cut into
micro-batches or shuffled within the lateness changes nothing.  What waits is ``lateness`` worth of samples
per key.  Rows at or before the time already worked off are late and dropped, by the same rule as Spark's own windows:
a batch works with the watermark of the batches before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from oscilla.config import DEFAULTS, Settings

TWO_PI = 2.0 * math.pi

# (memory, index, value or None) -> (memory, output values)
Recursion = Callable[[list[float], int, float | None], tuple[list[float], list[float | None]]]


def in_order(
    stream: DataFrame, key: str, ts: str, idx: str, value: str, lateness: str, recursion: Recursion, outputs: Sequence[str], idle: str = "1 day"
) -> DataFrame:
    """(key, ts, idx, *outputs), one row per sample, as soon as the watermark has passed it.

    The state of a key goes when the watermark is ``idle`` beyond its last sample; a later sample starts anew.
    Rows without a time or an index take no part; null is a key like any other.
    """
    known = stream.filter(F.col(ts).isNotNull() & F.col(idx).isNotNull())
    source = known.select(key, ts, F.col(idx).cast("long").alias("_i"), F.col(value).cast("double").alias("_v")).withWatermark(ts, lateness)
    schema = StructType().add(key, stream.schema[key].dataType).add(ts, "timestamp").add(idx, "long")
    for name in outputs:
        schema = schema.add(name, "double")
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, memory, waiting = -(2**62), [], pd.DataFrame({"t": [], "i": [], "v": []}).astype({"t": "int64", "i": "int64", "v": "float64"})
        if state.exists:
            done, memory, t, i, v = state.get
            memory, waiting = list(memory), pd.DataFrame({"t": np.asarray(t, "int64"), "i": np.asarray(i, "int64"), "v": np.asarray(v, "float64")})
        watermark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                times = pdf[ts].to_numpy().astype("datetime64[us]").astype("int64")
                arrived = pd.DataFrame({"t": times, "i": pdf["_i"].to_numpy("int64"), "v": pdf["_v"].to_numpy("float64")})
                waiting = pd.concat([waiting, arrived[arrived["t"] > done]], ignore_index=True)
        limit = watermark * 1000
        ready = waiting[waiting["t"] <= limit].sort_values(["t", "i", "v"], kind="stable")
        waiting = waiting[waiting["t"] > limit]
        found = []
        for i, v in zip(ready["i"], ready["v"], strict=True):
            memory, out = recursion(memory, int(i), None if math.isnan(v) else float(v))
            found.append(out)
        if len(ready):
            done = max(done, limit)
        if len(waiting):
            wake = int(waiting["t"].min() // 1000) + 1
        else:
            wake = max(done // 1000, watermark) + rest
            if state.hasTimedOut and not len(ready):
                state.remove()
                return
        state.update((done, [float(m) for m in memory], waiting["t"].tolist(), waiting["i"].tolist(), waiting["v"].tolist()))
        state.setTimeoutTimestamp(max(wake, watermark + 1))
        if found:
            columns = {ts: pd.to_datetime(ready["t"].to_numpy(), unit="us"), idx: ready["i"].to_numpy()}
            values = pd.DataFrame(found, columns=list(outputs), dtype="float64")
            yield pd.DataFrame({key: [group[0]] * len(ready), **columns}).join(values)

    kept = "done long, memory array<double>, t array<long>, i array<long>, v array<double>"
    return source.groupBy(key).applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def rotation(memory: list[float], idx: int, angle: float | None) -> tuple[list[float], list[float | None]]:
    """Unwrapped angle, amplitude so far and total rotation; a missing angle breaks the chain of differences."""
    last, unwrapped, low, high, total = memory or [math.nan, 0.0, 0.0, 0.0, 0.0]
    if angle is not None and not math.isnan(last):
        delta = (angle - last + math.pi) % TWO_PI - math.pi
        unwrapped += delta
        total += abs(delta)
        low, high = min(low, unwrapped), max(high, unwrapped)
    return [math.nan if angle is None else angle, unwrapped, low, high, total], [unwrapped, high - low, total]


def running_rotation(stream: DataFrame, key: str, ts: str, idx: str, angle: str, lateness: str) -> DataFrame:
    """Running rotation per recording or track: (key, ts, idx, unwrapped, amplitude, total)."""
    return in_order(stream, key, ts, idx, angle, lateness, rotation, ["unwrapped", "amplitude", "total"])


def one_euro_recursion(fps: float, settings: Settings = DEFAULTS) -> Recursion:
    """The filter of ``sequence.one_euro``: two or more missing samples restart it."""
    dt = 1.0 / max(fps, 1.0)

    def alpha(cutoff: float) -> float:
        return 1.0 / (1.0 + 1.0 / (TWO_PI * cutoff) / dt)

    a_d, low, beta = alpha(settings.one_euro_d_cutoff), settings.one_euro_min_cutoff, settings.one_euro_beta

    def step(memory: list[float], idx: int, value: float | None) -> tuple[list[float], list[float | None]]:
        if value is None:
            return memory, [None]
        if not memory or idx - memory[0] > 2:
            return [float(idx), value, 0.0], [value]
        _, x, dx = memory
        dx = a_d * ((value - x) / dt) + (1.0 - a_d) * dx
        a = alpha(low + beta * abs(dx))
        x = a * value + (1.0 - a) * x
        return [float(idx), x, dx], [x]

    return step


def one_euro_stream(
    stream: DataFrame, key: str, ts: str, idx: str, value: str, out: str, fps: float, lateness: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """(key, ts, idx, out), the filtered signal of each recording."""
    return in_order(stream, key, ts, idx, value, lateness, one_euro_recursion(fps, settings), [out])


def windowed_summary(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str, lateness: str, slide: str | None = None
) -> DataFrame:
    """Count, mean and range of a signal in tumbling windows, or sliding ones if ``slide`` is given.

    A window comes out once the watermark has passed its end.  A row is dropped for exactly those of its windows that
    are out by then.  Sums are combined before the shuffle, so a hot key costs one row per window and task.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(*keys, window.alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
        .select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), "n", "mean", "low", "high")
    )


# last-write-wins table


def _winners(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.max(row).alias("_m")).select(*keys, *[F.col(f"_m.row.{c}").alias(c) for c in rest])


def latest(spark: SparkSession, path: str, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the greatest version per key; of equal versions the later batch, then the greater row."""
    schema = spark.read.parquet(f"{path}/columns").schema
    names = schema.names
    full = StructType(list(schema.fields)).add("_batch", "long")
    upto = spark.read.schema("n long, upto long").parquet(f"{path}/folded").agg(F.max("upto")).first()[0]
    changes = spark.read.schema(full).option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    rows = changes
    if upto >= 0:
        rows = spark.read.schema(full).parquet(f"{path}/table/{upto}").unionByName(changes.filter(F.col("_batch") > upto))
    return _winners(rows, keys, [F.col(version), F.col("_batch")]).select(*names)


def merge_log(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, fold_every: int = 20):
    """Keep the last write per key.  A batch is stored under its number, so a replayed batch overwrites itself.

    Every ``fold_every`` batches the changes so far are folded into a table of winners; it counts only once
    a mark says that it is whole.  A null version is older than any other.
    """
    spark = stream.sparkSession
    names = stream.columns
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/columns")
    spark.createDataFrame([(0, -1)], "n long, upto long").write.mode("append").parquet(f"{path}/folded")

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        _winners(batch, keys, [F.col(version)]).select(*names).write.mode("overwrite").parquet(f"{path}/changes/_batch={number}")
        if (number + 1) % fold_every == 0:
            full = StructType(list(batch.schema.fields)).add("_batch", "long")
            past = session.read.schema(full).option("basePath", f"{path}/changes").parquet(f"{path}/changes")
            upto = session.read.schema("n long, upto long").parquet(f"{path}/folded").filter(F.col("upto") < number).agg(F.max("upto")).first()[0]
            rows = past.filter((F.col("_batch") > upto) & (F.col("_batch") <= number))
            if upto >= 0:
                rows = rows.unionByName(session.read.schema(full).parquet(f"{path}/table/{upto}"))
            folded = _winners(rows.withColumn("_from", F.col("_batch")), keys, [F.col(version), F.col("_from")]).drop("_from")
            folded.write.mode("overwrite").parquet(f"{path}/table/{number}")
            session.createDataFrame([(0, number)], "n long, upto long").write.mode("append").parquet(f"{path}/folded")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
