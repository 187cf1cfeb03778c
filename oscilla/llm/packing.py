"""Packing documents into sequences of bounded length by hierarchical residual packing.

A document longer than a sequence is cut into pieces that fill one each; its first piece and all
shorter documents are the items.  Partitions of bounded size pack their items best-fit, longest
first.  Sequences that are nearly full, or that no item left anywhere could enter, are final; the
others go on as single items, in at most half as many partitions each round, until one partition holds
them all or a round leaves as many as it got.  Where rounds save little, partitions grow as they get fewer.  Last, the nesting of items in items is unrolled round by round.

Cases: null text counts as empty, and an empty document is its end mark alone.  Rows that repeat an
identifier are separate documents.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oscilla.llm.bpe import encoder
from oscilla.llm.common import slices, texts_of
from oscilla.session import durable

PARTITION_ITEMS = 20_000
NEARLY_FULL = 0.995


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of the pieces of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                ids, counts = memo.values(texts[a:b])
                ids = np.insert(ids.astype("<u4"), np.cumsum(counts), end_id)
                counts = counts + 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = counts - capacity * (pieces - 1)
                length = np.where(piece == 0, first[row], capacity)
                start = np.where(piece == 0, 0, first[row] + capacity * (piece - 1))
                at = (np.cumsum(counts) - counts)[row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + a)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    schema = StructType().add("id", rows.schema["id"].dataType).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return rows.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; longest first, each into the fullest bin that it still enters."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []  # distinct free rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    bins = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(room, n)
        if at == len(room):
            free, b = capacity, bins
            bins += 1
        else:
            free = room[at]
            b = by_room[free].pop()
            if not by_room[free]:
                del by_room[free], room[at]
        where[i], offset[i] = b, capacity - free
        left = free - n
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(b)
    return where, offset


def _placer(capacity: int, last: bool, smallest: int, nearly_full: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Best fit of one partition; bins are final if they are nearly full or closed to every item left."""

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", ignore_index=True)
        where, offset = best_fit(frame["length"].to_numpy(), capacity)
        fill = np.bincount(where, weights=frame["length"]).astype(np.int64)
        done = last | (fill >= nearly_full * capacity) | (fill + smallest > capacity)
        # the least item of a bin names it: an item is in one bin only, so names are unique
        name = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(name, where, frame["item"].to_numpy())
        return pd.DataFrame({"item": frame["item"], "bin": name[where], "at": offset, "fill": fill[where], "done": done[where]})

    return place


def pack(items: DataFrame, capacity: int, partition_items: int = PARTITION_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Sequence and offset of each item of ``items`` (``item`` unique, ``length``): ``item``, ``seq``, ``offset``."""
    level, levels, left, parts = items.select("item", "length"), [], None, None
    while True:
        n, smallest = level.agg(F.count(F.lit(1)), F.min("length")).first()
        if not n:
            break
        wanted = -(-n // partition_items)
        parts = max(1, wanted if parts is None else min(wanted, parts // 2))
        last = parts == 1 or (left is not None and n >= left)
        left = n

        group = F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(parts)).alias("part")
        placed = durable(
            level.select("*", group).repartition(parts, "part").groupBy("part").applyInPandas(_placer(capacity, last, smallest, nearly_full), "item long, bin long, at long, fill long, done boolean")
        )
        levels.append(placed)
        if last:
            break
        level = placed.filter("NOT done").groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("length"))
    if not levels:
        return items.select("item", F.col("item").alias("seq"), F.col("length").alias("offset"))
    # unroll: the place of a bin in the next round is added to the places of its items
    above = levels[-1].select("item", F.col("bin").alias("seq"), F.col("at").alias("offset"))
    for placed in reversed(levels[:-1]):
        own = placed.filter("done").select("item", F.col("bin").alias("seq"), F.col("at").alias("offset"))
        up = above.select(F.col("item").alias("bin"), "seq", "offset")
        nested = placed.filter("NOT done").join(up, "bin").select("item", "seq", (F.col("offset") + F.col("at")).alias("offset"))
        above = own.unionByName(nested)
    return above


def pack_documents(
    docs: DataFrame, path: str, end_id: int, capacity: int = 1024, text: str = "text", ident: str = "doc_id", partition_items: int = PARTITION_ITEMS
) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = cut_pieces(docs, path, end_id, capacity, text, ident)
    # numbered as they are written, so the numbers stay the same afterwards
    numbered = durable(pieces.select("*", F.monotonically_increasing_id().alias("item")))
    full = numbered.filter(F.col("length") == capacity).select("item", F.col("item").alias("seq"), F.lit(0).cast("long").alias("offset"))
    packed = pack(numbered.filter(F.col("length") < capacity), capacity, partition_items)
    places = full.unionByName(packed)
    return numbered.join(places, "item").select("id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
