"""Mixing sources to target weights by temperature.

The token share p of each source is raised to an exponent a and normalised.  The weights share out a
budget, a part of the tokens of the corpus.  A source whose part exceeds its repetition limit is held there,
and what it can't take goes to the others in proportion to their weights, so a small source limits itself
only.  The exponent is the largest in [0, 1], found by bisection, whose mix has the target entropy: a share
of the greatest entropy that the limit allows at this budget (that of the flattest mix, a = 0), so a source
that can hardly be drawn hardly counts.  Without a target it is the smallest exponent that repeats no
source more than the limit allows.

A source's quota is drawn from permutations of its documents, one for each pass: documents are dealt
by a keyed hash into blocks, blocks are taken whole in the order of their number while the quota
lasts, and in the block where it ends documents are taken in the order of their hash.  A document is
drawn if the tokens before it in its permutation are fewer than the quota.  A block holds a bounded
number of documents, so a source with a third of all rows is spread over many tasks.

Only the totals of each source come to the driver, as many rows as there are sources.

Tokens are those of ``tokenizer`` (the path of its file), as the packing counts them; without one they are
runs of characters other than white space, which are few in languages without spaces.

Cases: a null source is a source of its own; null and empty texts have no tokens and are drawn with
whatever follows them.  Rows that repeat an identifier share a hash and are drawn in the order of
their place in the files.  Without any token nothing is drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oscilla.llm.bpe import encoder
from oscilla.llm.common import FILE, ROW, on_file, slices, texts_of, with_locator
from oscilla.session import durable

BLOCK_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Runs of characters other than white space in ASCII."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def tempered(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(n / total) ** exponent if n else 0.0 for n in tokens]
    whole = sum(raised)
    return [x / whole for x in raised]


def entropy(parts: list[float]) -> float:
    whole = sum(parts)
    return -sum(x / whole * math.log(x / whole) for x in parts if x > 0)


def shared_out(weights: list[float], limits: list[float], budget: float) -> list[float]:
    """Parts of the budget by weight; what exceeds a limit goes to the others by their weights."""
    parts, live, left = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0], budget
    while live:
        scale = left / sum(weights[i] for i in live)
        full = [i for i in live if weights[i] * scale >= limits[i]]
        if not full:
            for i in live:
                parts[i] = weights[i] * scale
            break
        for i in full:
            parts[i] = limits[i]
            left -= limits[i]
        live = [i for i in live if parts[i] == 0.0 and limits[i] > 0]
    return parts


def exponent_for(tokens: list[int], target: float | None, repeats: float | None, budget: int, rounds: int = 60) -> float:
    """Largest exponent whose mix has the target entropy; without one, the smallest that keeps the repetition limit."""
    limits = [math.inf if repeats is None else repeats * n for n in tokens]

    def reached(a: float) -> bool:
        return entropy(shared_out(tempered(tokens, a), limits, budget)) >= least

    def within(a: float) -> bool:
        return all(w * budget <= limit * (1 + 1e-12) for w, limit in zip(tempered(tokens, a), limits, strict=True))

    def bisect(good: float, bad: float, test) -> float:  # noqa: ANN001
        if test(bad):
            return bad
        for _ in range(rounds):
            mid = (good + bad) / 2
            good, bad = (mid, bad) if test(mid) else (good, mid)
        return good

    if target is not None:
        least = target * entropy(shared_out(tempered(tokens, 0.0), limits, budget)) * (1 - 1e-12)
        return bisect(0.0, 1.0, reached)
    return bisect(1.0, 0.0, within)


def plan_quotas(tokens: list[int], target: float | None = None, repeats: float | None = 1.0, budget: int | None = None) -> list[int]:
    """Tokens to draw from each source; the budget is all tokens unless it is given."""
    total = sum(tokens)
    budget = total if budget is None else budget
    if not budget:
        return [0] * len(tokens)
    limits = [math.inf if repeats is None else repeats * n for n in tokens]
    parts = shared_out(tempered(tokens, exponent_for(tokens, target, repeats, budget)), limits, budget)
    return [math.floor(x + 0.5) for x in parts]


def token_lengths(rows: DataFrame, path: str) -> DataFrame:
    """``who`` and ``tokens``, the number of ids of ``text`` as the packing counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            lengths = [memo.values(texts[a:b])[1] for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("who"), pa.array(np.concatenate(lengths) if lengths else [], pa.int64())], ["who", "tokens"])

    return rows.mapInArrow(run, StructType().add("who", rows.schema["who"].dataType).add("tokens", "long"))


def mix(
    docs: DataFrame,
    target: float | None = 0.9,
    repeats: float | None = 1.0,
    budget: int | None = None,
    kept: float = 1.0,
    text: str = "text",
    source: str = "source",
    ident: str = "doc_id",
    seed: str = "mix",
    tokenizer: str | None = None,
) -> DataFrame:
    """The drawn rows: their locator, ``id``, ``source``, ``tokens``, the pass (``epoch``) and ``block``.

    The budget is the part ``kept`` of all tokens unless it is given.
    """
    spark = docs.sparkSession
    placed = with_locator(docs).select(F.struct(FILE, ROW, F.col(ident).alias("id"), F.col(source).cast("string").alias("source")).alias("who"), F.col(text).alias("text"))
    if tokenizer is None:
        sized = placed.select("who.*", word_count(F.col("text")).alias("tokens"))
    else:
        sized = token_lengths(placed, tokenizer).select("who.*", "tokens")
    sized = durable(sized)
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("source").collect()
    tokens = [r["t"] for r in totals]
    quotas = plan_quotas(tokens, target, repeats, math.floor(kept * sum(tokens)) if budget is None else budget)
    # passes over each source: whole ones, and one that ends inside
    passes = [
        (r["source"], e, min(q - e * r["t"], r["t"]), -(-r["n"] // BLOCK_ROWS))
        for r, q in zip(totals, quotas, strict=True)
        if r["t"]
        for e in range(-(-q // r["t"]))
    ]
    plan = spark.createDataFrame(passes, "source string, epoch int, quota long, blocks long")
    drawn = sized.join(F.broadcast(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    number = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    dealt = drawn.withColumn("key", key).withColumn("block", F.floor(number * F.col("blocks") / F.lit(1 << 32)).cast("long"))
    per_block = dealt.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("bt"))
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("before", F.coalesce(F.sum("bt").over(before), F.lit(0)))
    per_block = per_block.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), "before")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b"))
    reached = dealt.join(per_block, same).filter(F.col("before") < F.col("quota"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("key", FILE, ROW).rowsBetween(Window.unboundedPreceding, -1)
    running = reached.withColumn("ahead", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return running.filter(F.col("ahead") < F.col("quota")).select(FILE, ROW, "id", "source", "tokens", "epoch", "block", F.col("ahead").alias("position"))


def draw(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, once for each pass that draws them."""
    docs = on_file(docs)
    rows = durable(mix(docs, **options).select(FILE, ROW))
    return with_locator(docs).join(rows.hint("merge"), [FILE, ROW]).select(docs.columns)
