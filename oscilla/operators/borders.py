"""Windows over rows that are cut into slices: border rows and carried sums.

Rows cut by :func:`slice_by_order` lie in ranges of (keys, order), so a key with most of the rows spreads
over many slices.  A window needs rows beyond the border of its slice; those few are copied:

* the last rows before and the first rows after a slice, as many as the window is wide;
* the nearest row on either side that meets a condition (the last sample seen, say), however far.

What accumulates over a whole key (running sums, totals) is a number per key and slice, carried from the
earlier slices.  Only keys that cross a border need any of this, at most two per slice, so border rows
and carried numbers grow with the number of slices, not with the data.  A frame without a slice
column is handled by plain windows over its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.operators.ordering import SLICE, _attach_carry
from oscilla.session import durable

OWN = "_own"
Step = Callable[[DataFrame, list[str]], DataFrame]


def across(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    step: Step,
    before: int = 0,
    after: int = 0,
    near: Column | None = None,
) -> DataFrame:
    """Apply ``step``, which adds window columns over the keys it is given, as if recordings were whole.

    ``before`` and ``after`` say how many rows beyond a row the windows reach; with ``near`` they also
    find the nearest row on either side that meets it.
    """
    if SLICE not in df.columns:
        return step(df, list(keys))
    return step(with_borders(df, keys, idx, before, after, near), [SLICE, *keys]).filter(OWN).drop(OWN)


def _ends(df: DataFrame, by: list[str], idx: str, rows: int, last: bool) -> DataFrame:
    """The last (or first) ``rows`` rows of each slice and key, in order, as an array."""
    name = "_tail" if last else "_head"
    row = F.struct(*[c for c in df.columns if c != SLICE])
    if rows == 1:
        pick = F.max_by if last else F.min_by
        return df.groupBy(*by).agg(F.array(pick(row, F.col(idx))).alias(name))
    order = F.col(idx).desc() if last else F.col(idx).asc()
    near = df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_place") <= rows)
    listed = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("_at"), row.alias("_row"))))
    return near.groupBy(*by).agg(F.transform(listed, lambda x: x["_row"]).alias(name))


def with_same_keys(df: DataFrame, by: Sequence[str], other: DataFrame) -> DataFrame:
    """Join whose null keys match."""
    match = F.lit(True)
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return df.join(other.select(*[F.col(k).alias(f"_o_{k}") for k in by], *[c for c in other.columns if c not in by]), match).drop(
        *[f"_o_{k}" for k in by]
    )


def with_borders(df: DataFrame, keys: Sequence[str], idx: str, before: int = 0, after: int = 0, near: Column | None = None) -> DataFrame:
    """Add to each slice the rows beyond its borders; ``_own`` tells its own rows."""
    by = [SLICE, *keys]
    row = F.struct(*[c for c in df.columns if c != SLICE])
    marks = []
    if near is not None:
        at = F.when(near, F.col(idx))
        marks = [F.max_by(row, at).alias("_last"), F.min_by(row, at).alias("_first")]
    slices = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *marks)
    if before:
        slices = with_same_keys(slices, by, _ends(df, by, idx, before, last=True))
    if after:
        slices = with_same_keys(slices, by, _ends(df, by, idx, after, last=False))
    order = Window.partitionBy(*keys).orderBy(SLICE)
    found = []
    if before:
        earlier = F.flatten(F.collect_list("_tail").over(order.rowsBetween(-before, -1)))
        found.append(F.slice(earlier, F.greatest(F.size(earlier) - before, F.lit(0)) + 1, F.lit(before)))
    if after:
        found.append(F.slice(F.flatten(F.collect_list("_head").over(order.rowsBetween(1, after))), 1, after))
    if near is not None:
        found.append(F.array(F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
        found.append(F.array(F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))))
    # each list is computed in a column of its own: a window can't stand inside a generator
    named = slices.select(SLICE, *[f.alias(f"_f{i}") for i, f in enumerate(found)])
    rows = F.array_distinct(F.array_compact(F.concat(*[F.col(f"_f{i}") for i in range(len(found))])))
    borders = named.select(SLICE, F.explode(rows).alias("_r")).select(SLICE, "_r.*", F.lit(False).alias(OWN))
    return df.withColumn(OWN, F.lit(True)).unionByName(borders)


def running(df: DataFrame, keys: Sequence[str], idx: str, sums: Mapping[str, str], inclusive: bool = True) -> DataFrame:
    """Add running sums ``{output: input}`` in the order of ``idx``, with or without the row itself."""
    by = [SLICE, *keys] if SLICE in df.columns else list(keys)
    # the sums of whole slices are read besides the rows, so what they come from is computed once
    rows = durable(df) if SLICE in df.columns else df
    here = Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumns({n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()})
    if SLICE not in df.columns:
        return local
    return _attach_carry(local, rows, keys, {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in sums.items()}, keep_slice=True)


def totals(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Add totals of each key, from aggregates that add up (sums and counts)."""
    if SLICE not in df.columns:
        return df.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in sums.items()})
    whole = Window.partitionBy(*keys)
    slices = df.groupBy(SLICE, *keys).agg(*[c.alias(f"_t_{n}") for n, c in sums.items()])
    crossing = (
        slices.select("*", F.count(F.lit(1)).over(whole).alias("_spans"), *[F.sum(f"_t_{n}").over(whole).alias(f"_w_{n}") for n in sums])
        .filter(F.col("_spans") > 1)
        .select(F.col(SLICE).alias("_cs"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_w_{n}" for n in sums])
    )
    match = F.col(SLICE) == F.col("_cs")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    local = df.withColumns({n: c.over(Window.partitionBy(SLICE, *keys)) for n, c in sums.items()})
    # a row for each key and slice of the keys that cross a border: at most two per slice
    joined = local.join(F.broadcast(crossing), match, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"_w_{n}"), F.col(n)).alias(n) for n in sums])
