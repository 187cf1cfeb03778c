"""Exact deduplication by keyed streaming state.

Digests of the normalised texts arrive as a stream.  The state, kept on disk by the RocksDB state
store and never expired, holds for each digest how many rows arrived, and the stable identifier and
content locator (file, row in the file) of the row that stays so far.  Rows whose digest was there
already are hits; the full normalised bytes of their groups are compared afterwards, and a digest
that stands for several texts is split into one group for each.

Everything is made of DataFrame operations.  Text travels only for hits; a digest that a third of
all rows share is folded before each shuffle.

Cases: null text counts as empty; all empty texts are one group.  A null identifier loses against
any other.  Rows that repeat an identifier and its text are told apart by their locator, so exactly
one row of a group stays.  An empty table gives an empty result.  Further columns of the input are
not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.llm.common import FILE, ROW, new_folder, on_file, with_locator
from oscilla.session import durable

BLANKS = " \t\n\x0b\x0c\r"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: without this each sets megabytes of disk aside
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def without_blanks(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _configured(spark: SparkSession, values: dict[str, str]) -> dict[str, str | None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    return before


def registry(arrivals: DataFrame, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream the rows written at ``path`` through the keyed state and read the state back."""
    spark = arrivals.sparkSession
    checkpoint = new_folder(spark, "dedup-state")
    before = _configured(spark, STATE_CONF)
    try:
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        # fewest characters below zero first, that is the longest text, then the smallest identifier
        best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), "id", FILE, ROW))
        state = stream.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        value = kept.schema["value"].dataType.names
        best, n = F.col("value")[value[0]], F.col("value")[value[1]]
        return durable(
            kept.select(
                F.col("key.digest").alias("digest"),
                best["id"].alias("keep_id"),
                best[FILE].alias("keep_file"),
                best[ROW].alias("keep_row"),
                n.cast("long").alias("group_size"),
            )
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_groups(
    docs: DataFrame,
    text: str = "text",
    ident: str = "doc_id",
    normalise: Callable[[Column], Column] = without_blanks,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: its locator, ``id``, ``digest``, ``keep_id``, ``group_size``, ``kept``."""
    spark, docs = docs.sparkSession, on_file(docs)
    placed = with_locator(docs).select(
        F.col(ident).alias("id"), normalise(F.col(text)).alias("norm"), F.char_length(F.coalesce(text, F.lit(""))).alias("chars"), FILE, ROW
    )
    path = new_folder(spark, "dedup-arrivals")
    placed.select(digest(F.col("norm")).alias("digest"), "id", "chars", FILE, ROW).write.parquet(path)
    arrivals = spark.read.parquet(path)
    if arrivals.isEmpty():
        return arrivals.select(FILE, ROW, "id", "digest", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    held = registry(arrivals, path)
    here = (F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))
    out = arrivals.join(held, "digest").select(FILE, ROW, "id", "digest", "keep_id", "group_size", here.alias("kept"))
    # full bytes of every group with a hit: all equal if the least and the greatest are
    shared = held.filter("group_size > 1").select("digest")
    hits = durable(arrivals.join(shared, "digest", "left_semi").select(FILE, ROW, "digest"))
    # texts are dealt by their place at every size, so that the plan doesn't change where hits outgrow a broadcast
    texts = placed.join(hits.hint("merge"), [FILE, ROW])
    mixed = durable(
        texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest")
    )
    if mixed.isEmpty():
        return out
    torn = durable(texts.join(mixed, "digest", "left_semi"))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), "id", FILE, ROW))
    apart = torn.groupBy("digest", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    here = (F.col(FILE) == F.col("best")[FILE]) & (F.col(ROW) == F.col("best")[ROW])
    split = torn.join(apart, ["digest", "norm"]).select(
        FILE, ROW, "id", "digest", F.col("best.id").alias("keep_id"), "group_size", here.alias("kept")
    )
    return out.join(mixed, "digest", "left_anti").select(split.columns).unionByName(split)


def drop_copies(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that repeat another one's normalised text."""
    docs = on_file(docs)
    groups = exact_groups(docs, text, ident)
    dropped = durable(groups.filter(~F.col("kept")).select(FILE, ROW))
    return with_locator(docs).join(dropped.hint("merge"), [FILE, ROW], "left_anti").select(docs.columns)
