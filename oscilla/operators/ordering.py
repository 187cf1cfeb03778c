"""Ordered operators that stay correct and parallel when one key holds most of the rows.

A window or an exact percentile per key gathers that key in one task.  Here the rows are cut by
*range* of (key, order) instead, so a hot key spreads over many slices.  There is one plan, whatever
the sizes of the groups; nothing is measured to choose it.

Window functions run inside a slice; what a slice has to know about the earlier slices of the
same key is a carry table.  A key has a carry row only where it crosses a slice border, so that
table holds at most two rows per slice whatever the size of the data, and it is the only thing
broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.session import durable, shuffle_slices

SLICE = "_slice"


def slice_by_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None
) -> DataFrame:
    """Cut ``df`` into ranges of (keys, order); rows that compare equal share a slice."""
    count = slices or shuffle_slices(df.sparkSession)
    ranged = df.repartitionByRange(count, *[F.col(c) for c in (*keys, *order)])
    return durable(ranged.withColumn(SLICE, F.spark_partition_id()))


def _attach_carry(
    local: DataFrame,
    sliced: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, Column],
    keep_slice: bool = False,
) -> DataFrame:
    """Add to each running column what the earlier slices of the same key summed up to."""
    per_slice = sliced.groupBy(SLICE, *keys).agg(*[c.alias(f"_c_{n}") for n, c in totals.items()])
    same_key = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = same_key.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_slice.withColumn("_spans", F.count(F.lit(1)).over(same_key))
        .filter(F.col("_spans") > 1)
        .select(
            F.col(SLICE).alias("_cs"),
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            *[F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in totals],
        )
    )
    match = F.col(SLICE) == F.col("_cs")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carry), match, "left")
    kept = [c for c in local.columns if c not in totals and (keep_slice or c != SLICE)]
    return joined.select(
        *kept,
        *[(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in totals],
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "row_no",
    slices: int | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """Zero-based row number per key in a total order."""
    sliced = slice_by_order(df, keys, order, slices)
    here = Window.partitionBy(SLICE, *keys).orderBy(*order)
    local = sliced.withColumn(name, (F.row_number().over(here) - 1).cast("long"))
    return _attach_carry(local, sliced, keys, {name: F.count(F.lit(1))}, keep_slice)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``{output: input}`` per key in a total order."""
    sliced = slice_by_order(df, keys, order, slices)
    here = (
        Window.partitionBy(SLICE, *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.select("*", *[F.sum(c).over(here).alias(n) for n, c in values.items()])
    return _attach_carry(local, sliced, keys, {n: F.sum(c) for n, c in values.items()})


def tie_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    slices: int | None = None,
) -> DataFrame:
    """For weighted rows add ``below`` (weight of smaller values) and ``ties`` (of equal ones).

    Callers pre-aggregate to one row per (key, value, attributes) first, so a value that a third
    of all rows share is one row here.  The average rank is ``below + (ties + 1) / 2``.
    """
    base = slice_by_order(df, keys, [value], slices)
    peers = Window.partitionBy(SLICE, *keys).orderBy(value)
    upto = peers.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = peers.rangeBetween(Window.currentRow, Window.currentRow)
    ranked = base.select(
        "*",
        F.sum(weight).over(equal).alias("ties"),
        (F.sum(weight).over(upto) - F.sum(weight).over(equal)).alias("below"),
    )
    return _attach_carry(ranked, base, keys, {"below": F.sum(weight)})


def average_rank() -> Column:
    return F.col("below") + (F.col("ties") + F.lit(1)) / F.lit(2.0)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    slices: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, without holding a key in one task.

    Rows collapse to distinct (key, value) counts before the ordered exchange; the two ranks that
    bracket each percentile are then picked out by a combinable aggregate.
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, value)
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = tie_ranks(counts, keys, value, "_n", slices)
    totals = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        right = totals.select(
            *[F.col(k).alias(f"_t_{k}") for k in keys], "_total"
        )
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        ranked = ranked.join(right, match, "inner")
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    picks = []
    for name, p in points.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            covers = (F.col("below") <= rank) & (rank < F.col("below") + F.col("ties"))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, p in points.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        share = position - F.floor(position)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * share).alias(name))
    return picked.select(*keys, *out)


def to_recordings(
    df: DataFrame,
    stream: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Number the samples of each stream; a stream is one whole recording, whatever its length.

    Adds ``clip``, which is 0, and ``frame_idx``, and keeps the number of the slice a row lies in, so
    that the signal operators work slice by slice (see :mod:`oscilla.operators.borders`): a stream
    with a third of all rows is spread over many tasks, and no gap, cycle or event is torn.
    """
    numbered = number_rows(df, stream, order, "frame_idx", keep_slice=True)
    return numbered.withColumn("clip", F.lit(0).cast("long"))
