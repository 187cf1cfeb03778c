"""Deduplication of repeated passages by overlapping windows of three lines.

Each window of consecutive lines gets a 128-bit hash.  A window that stands earlier in the corpus, in
the order of (identifier, line number), is a repeat; the lines that repeats cover are merged into one
set and removed.  Windows are judged on the input, so what is removed doesn't depend on what else is.

Only hashes and positions are shuffled, and texts are joined once with the few positions to remove.
A window that many documents share is folded to its first place before the shuffle.

Cases: null text counts as empty.  A text of fewer than three lines has no window.  Windows without a
visible character don't count.  Rows that repeat an identifier count in the order of their place in
the input files.  Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.llm.common import FILE, ROW, on_file, with_locator
from oscilla.session import durable

BLANK = " \t\n\x0b\f\r"


def windows(texts: DataFrame, text: str, size: int) -> DataFrame:
    """``texts`` with one row per window that has a visible character: start line ``pos`` and ``hash``.

    A text is split once; its lines pass through the generator as they are and only hashes leave the stage.
    """
    others = [c for c in texts.columns if c != text]
    split = texts.select(*others, F.split(text, "\n", -1).alias("_lines")).filter(F.size("_lines") >= size)
    starts = split.select(*others, "_lines", F.explode(F.sequence(F.lit(0), F.size("_lines") - size)).alias("pos"))
    window = F.array_join(F.slice("_lines", F.col("pos") + 1, size), "\n")
    joined = starts.select(*others, "pos", window.alias("_w")).filter(F.ltrim("_w", F.lit(BLANK)) != "")
    return joined.select(*others, "pos", F.unhex(F.md5("_w")).alias("hash"))


def repeated_windows(docs: DataFrame, text: str = "text", ident: str = "doc_id", size: int = 3) -> DataFrame:
    """Start line (from 0) of each window that stands earlier in the corpus, by row locator."""
    placed = with_locator(docs).select(F.col(ident).alias("id"), FILE, ROW, F.coalesce(text, F.lit("")).alias("_text"))
    found = durable(windows(placed, "_text", size))
    place = F.struct(F.col("id").isNotNull().alias("z"), "id", FILE, ROW, "pos")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = (F.col(FILE) != F.col("first")[FILE]) | (F.col(ROW) != F.col("first")[ROW]) | (F.col("pos") != F.col("first.pos"))
    return found.join(first, "hash").filter(later).select(FILE, ROW, "pos")


def drop_repeated_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id", size: int = 3) -> DataFrame:
    """One row per document: ``id``, ``n_lines``, ``n_removed`` and the ``text`` that stays."""
    docs = on_file(docs)
    placed = with_locator(docs).select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text"), FILE, ROW)
    covered = durable(
        repeated_windows(docs, text, ident, size)
        .groupBy(FILE, ROW)
        .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", F.col("pos") + size - 1)))).alias("gone"))
    )
    lines = F.split("text", "\n", -1)
    marked = placed.join(covered.hint("merge"), [FILE, ROW], "left").withColumn("gone", F.map_from_arrays("gone", "gone"))
    stay = F.filter(lines, lambda _, i: ~F.coalesce(F.map_contains_key("gone", i), F.lit(False)))
    return marked.select(
        "id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
    )
