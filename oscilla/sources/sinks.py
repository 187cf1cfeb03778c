"""Sinks: result tables, report files, exported signals, label lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscilla.operators.jobs import keep_last
from oscilla.operators.sequence import let


def encode_series(values: Column, decimals: int = 4) -> Column:
    """Compact JSON text of a numeric array; missing and non-finite values become null."""

    def clean(v: Column) -> Column:
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.bround(v, decimals))

    text = F.transform(
        values, lambda v: F.coalesce(F.to_json(F.struct(clean(v.cast("double")).alias("v"))), F.lit("null"))
    )
    # one number per {"v":...} object; an object without a value is a null
    numbers = F.transform(
        text, lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r'^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))
    )
    return F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]"))


def fixed_length(values: Column, length: int = 1024) -> Column:
    """z-normalised signal, cropped or zero-padded to a fixed length."""
    clean = F.transform(
        values, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    )

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def scaled(a: Column, mean: Column) -> Column:
        squares = total(F.transform(a, lambda v: (v - mean) * (v - mean)))
        return let(
            F.sqrt(squares / F.size(a)),
            lambda sd: F.transform(a, lambda v: F.when(sd > 1e-9, (v - mean) / sd).otherwise(v)),
        )

    normal = let(clean, lambda a: let(total(a) / F.size(a), lambda mean: scaled(a, mean)))
    return F.slice(F.concat(normal, F.array_repeat(F.lit(0.0), length)), 1, length)


def write_log(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append records; the committed files are the only state a resumed run reads."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def compact_log(log: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """Write the last record per key to a new folder."""
    keep_last([log], keys, order).write.mode("errorifexists").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report tables as CSV with a header or as JSON lines; partitions stay separate files."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.format(fmt).save(path)


def write_dataset(tables: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """The tables of a data set below ``root``; the id map has no header, as its reader expects.  Returns their paths."""
    paths = {name: f"{root}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", name != "id_map").csv(paths[name])
    return paths


def write_label_lines(df: DataFrame, path: str, line: str = "line", split: str = "split") -> None:
    """Label text, one folder per split."""
    df.select(split, line).write.mode("overwrite").partitionBy(split).text(path)
