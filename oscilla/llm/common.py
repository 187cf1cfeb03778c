"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.session import durable, shared_folder

FILE, ROW = "_llm_file", "_llm_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/oscilla-{what}-{uuid.uuid4().hex}"


def on_file(docs: DataFrame) -> DataFrame:
    """``docs``, written to the shared folder unless it is read from Parquet."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return durable(docs)


def with_locator(docs: DataFrame) -> DataFrame:
    """Add the place of each row (file, row number in it), which tells repeated rows apart.

    The place of a row is the same in every job.  Callers that use it twice pass ``on_file(docs)``.
    """
    return on_file(docs).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def held_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def hash_sample(rows: DataFrame, key: Column, at_most: int) -> DataFrame:
    """About ``at_most`` rows chosen by a hash of ``key``, all of them if there are no more.

    One count goes to the driver; which rows are taken does not depend on partitions or order.
    """
    total = rows.count()
    if total <= at_most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * at_most / total))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def slices(texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters, so that kernels hold little at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
