"""Batch bookkeeping as tables: what is done, what is left, who does it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscilla.operators.ordering import number_rows


def unlogged(source: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Recordings of the source list that no log mentions."""
    return source.join(log.select(key).distinct(), key, "left_anti")


def membership(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of two lists once, with ``side``: 'both', 'first' or 'second'.  Null is a key like any other.

    Flags are combined before the shuffle, so a key that is repeated often costs one row per task.
    """
    flags = [d.select(*keys, F.lit(first).alias("_f"), F.lit(not first).alias("_s")) for d, first in ((a, True), (b, False))]
    sides = flags[0].unionByName(flags[1]).groupBy(*keys).agg(F.bool_or("_f").alias("_f"), F.bool_or("_s").alias("_s"))
    side = F.when(F.col("_f") & F.col("_s"), "both").when(F.col("_f"), "first").otherwise("second")
    return sides.select(*keys, side.alias("side"))


def valid_payload(main_track_found: Column, conf_min: Column, conf_used: Column) -> Column:
    """A logged recording counts as done when it has no track or carries usable confidences."""
    carried = (
        (F.size(conf_min) > 0) & (F.size(conf_used) > 0) & F.exists(conf_min, lambda v: v.isNotNull())
    )
    return ~F.coalesce(main_track_found, F.lit(False)) | F.coalesce(carried, F.lit(False))


def remaining(tasks: DataFrame, log: DataFrame, keys: Sequence[str], done: Column) -> DataFrame:
    """Tasks without a valid finished record."""
    finished = log.filter((F.col("record_type") == "VIDEO") & done).select(*keys).distinct()
    return tasks.join(finished, list(keys), "left_anti")


def to_retry(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose latest records hold no success."""
    return (
        log.groupBy(*keys)
        .agg(F.count_if(F.col("record_type") == "VIDEO").alias("_ok"))
        .filter(F.col("_ok") == 0)
        .drop("_ok")
    )


def keep_last(logs: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Union of logs with differing columns, the last record per key (combines map-side)."""
    merged = logs[0]
    for other in logs[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    rest = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(
        *keys, "_r.*"
    )


def stripe(tasks: DataFrame, order: Sequence[str], nodes: int, rank: int) -> DataFrame:
    """Every ``nodes``-th task from ``rank`` on."""
    numbered = number_rows(tasks, [], order, "_i")
    return numbered.filter(F.col("_i") % nodes == rank).drop("_i")


def proportional_slice(tasks: DataFrame, order: Sequence[str], start: float, stop: float) -> DataFrame:
    """The contiguous share [start, stop) of the ordered tasks."""
    numbered = number_rows(tasks, [], order, "_i")
    total = tasks.agg(F.count(F.lit(1)).alias("n")).scalar()
    return numbered.filter(
        (F.col("_i") >= F.rint(total * start)) & (F.col("_i") < F.rint(total * stop))
    ).drop("_i")


def seeded_share(key: Column, seed: int) -> Column:
    """Number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample(tasks: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Seeded sample of n tasks: the n smallest hashes."""
    return tasks.orderBy(seeded_share(F.col(key), seed), key).limit(n)
