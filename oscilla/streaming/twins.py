"""Structured Streaming twins of the stateful batch operators.

The engine's own work is batch; these let the same steps run on arriving files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from oscilla.config import DEFAULTS, Settings
from oscilla.operators.tracking import Tracker


def stream_table(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 64
) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append finished records as they arrive; readers keep the last record per key."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def activity_sessions(
    stream: DataFrame, keys: Sequence[str], ts: str, gap: str, lateness: str
) -> DataFrame:
    """Active spans per stream, closed after a gap without samples."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(*keys, F.session_window(ts, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("stop"), "n")
    )


def track_stream(
    stream: DataFrame,
    fps: float,
    expected: str | None = None,
    key: str = "video",
    settings: Settings = DEFAULTS,
    ts: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Incremental association; frames of a recording arrive in order, a batch holds whole frames.

    ``stream`` has (key, frame_idx, det_idx, label, x, y).  The state keeps live tracks only, so it
    stays a few rows per recording however long the stream runs.  With a time column
    ``ts``, a recording that the watermark (``lateness`` behind the latest time) has passed is over and
    its state goes; without one, there is no telling when a recording ends, and its state stays.
    """
    if ts:
        stream = stream.withWatermark(ts, lateness)
    output = StructType().add(key, stream.schema[key].dataType).add("frame_idx", "long").add("det_idx", "long").add("track", "integer")
    state_schema = "first int, rows array<double>"

    def run(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker(fps, expected, settings)
        if state.exists:
            tracker.gone, rows = state.get
            tracker.state = np.asarray(rows, dtype=float).reshape(-1, 5)
        pdf = pd.concat(list(batches)).sort_values(["frame_idx", "det_idx"], kind="stable")
        tracks: list[int] = []
        for frame, part in pdf.groupby("frame_idx", sort=True):
            labels = [None if pd.isna(v) else v for v in part["label"]]
            tracks += tracker.step(int(frame), part[["x", "y"]].to_numpy(float), labels)
            tracker.forget(int(frame))
        state.update((tracker.gone, [float(v) for v in tracker.state.ravel()]))
        if ts:
            seen = int(pdf[ts].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + 1)
        yield pdf[[key, "frame_idx", "det_idx"]].assign(track=tracks)

    return stream.groupBy(key).applyInPandasWithState(
        run, output, state_schema, "append", GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    )
