"""Hard negatives by rotated one-bit codes, deterministic intervals and integer scores.

Each vector is rotated (random signs, then a Hadamard transform) and its signs are a one-bit code, one
popcount word for 64 dimensions.  The alignment of the code with the vector is stored; what the code
leaves is rotated and coded again, for ``ROUNDS`` rounds, and the norm of the rest after each round is
stored too.  A query is rotated alike and cut into ``PLANES`` bit planes, so the inner product of query
and code is a sum of popcounts.  By Cauchy and Schwarz the true score differs from this estimate by at
most |query| * |rest| plus alignment * |what the planes left of the query|: an interval without chance.

Rows whose interval can't reach the k best of their query are dropped round by round; the ones left are
scored in integers, and only those scores decide.  Rows are dealt into blocks by row, a block holds a
bounded number, and the queries pass every block in a stream, so a task holds one block and one batch
of queries.  Rows are shuffled once, queries once for each block, and each block returns the k best of
each query and positive.

Cases: rows with a null identifier, a null label, a null vector or a null or non-finite component take
no part.  Shorter vectors count as filled with zeros.  Components and scores beyond a long are held at
its bounds.  Ties go to the smaller identifier.  Of rows that repeat an anchor's identifier the one with
the least label, then vector, is the anchor, and the others never meet it; other repeated rows count
each.  An anchor without positives, or a positive without negatives in its range, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.llm.topk import scaled
from oscilla.session import durable, shuffle_slices

ROUNDS, PLANES, DENSE = 6, 6, 3  # rounds of codes, bit planes of a query, rounds before rows are dropped
BLOCK_ROWS, LEAST_ROWS, CHUNK, BATCH = 262_144, 4_096, 16_384, 64
LONG = np.iinfo(np.int64)
FOUND = "query_id long, pos int, positive_id long, positive_score long, id long, score long"


# codes


def rotated(x: np.ndarray, turn: int) -> np.ndarray:
    """Rows of ``x`` (a power of two long) with random signs, transformed; norms and products stay."""
    n, width = x.shape
    x = x * (np.random.default_rng([7, turn]).integers(0, 2, width) * 2.0 - 1)
    half = 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def words(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encode(x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, round, word), alignments (row, round) and norms of the rest (row, round)."""
    n, width = x.shape
    codes = np.empty((n, rounds, width // 64), "<u8")
    aligned, rest = np.empty((n, rounds)), np.empty((n, rounds))
    for r in range(rounds):
        x = rotated(x, r)
        up = x > 0
        codes[:, r] = words(up)
        aligned[:, r] = np.abs(x).sum(1) / np.sqrt(width)
        x = x - np.where(up, 1.0, -1.0) * (aligned[:, r] / np.sqrt(width))[:, None]
        rest[:, r] = np.sqrt(np.square(x).sum(1))
    return codes, aligned, rest


class Planes:
    """Bit planes of queries in the frame of each round."""

    def __init__(self, x: np.ndarray, rounds: int = ROUNDS, planes: int = PLANES) -> None:
        self.width, self.norm = x.shape[1], np.sqrt(np.square(x).sum(1))
        self.rounds = []
        for r in range(rounds):
            x = rotated(x, r)
            low = x.min(1, keepdims=True)
            step = np.maximum((x.max(1, keepdims=True) - low) / (2**planes - 1), np.finfo(float).tiny)
            level = np.rint((x - low) / step).astype(np.int64)
            left = np.sqrt(np.square(x - low - step * level).sum(1))
            bits = np.stack([words((level >> p) & 1 == 1) for p in range(planes)], axis=1)
            self.rounds.append((low[:, 0], step[:, 0], level.sum(1), bits, left))

    def product(self, r: int, codes: np.ndarray, which: slice | int) -> np.ndarray:
        """Product of the cut queries ``which`` with the codes of round ``r`` (signs over the root of the width)."""
        low, step, total, bits, _ = (a[which] for a in self.rounds[r])
        ones = np.bitwise_count(codes).sum(-1, dtype=np.int64)
        count = np.zeros((*np.shape(low), len(codes)), np.int64)
        for p in range(bits.shape[-2]):
            met = np.bitwise_count(bits[..., p, None, :] & codes).sum(-1, dtype=np.int64)
            count += met << p
        wide = lambda a: np.asarray(a)[..., None]
        return (wide(low) * (2 * ones - self.width) + wide(step) * (2 * count - wide(total))) / np.sqrt(self.width)


# search in a block


class Block:
    """Rows of one block: vectors, codes, labels, identifiers."""

    def __init__(self, batches: list[pa.RecordBatch], width: int) -> None:
        rows = pa.Table.from_batches(batches)
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.v = matrix(rows["v"], width)
        self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), "<u8").reshape(len(self.ids), -1, width // 64)
        scales = np.array(rows["scales"].combine_chunks().flatten()).reshape(len(self.ids), 2, -1)
        self.aligned, self.rest = scales[:, 0], scales[:, 1]
        self.norm = np.sqrt(np.square(self.v.astype(float)).sum(1))
        self.most = int(np.abs(self.v.astype(float)).max(initial=0))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def integer_scores(rows: np.ndarray, query: np.ndarray, most: int) -> np.ndarray:
    """Exact products, held at the bounds of a long."""
    if float(np.abs(query.astype(float)).sum()) * most < 2**62:
        return rows @ query
    exact = [sum(a * b for a, b in zip(r, query.tolist(), strict=True)) for r in rows.tolist()]
    return np.array([min(max(s, -LONG.max), LONG.max) for s in exact], np.int64)


def ranges(positives: list[dict] | None, share: tuple[int, int] | None) -> list[tuple[int, int, int, int]]:
    """Of each positive: identifier, score, least and greatest score of its negatives; all scores without positives."""
    if positives is None or share is None:
        return [(0, 0, -LONG.max, LONG.max)]
    return [(p["id"], p["score"], -(-share[0] * p["score"] // 100), share[1] * p["score"] // 100) for p in positives]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(block: Block, asked: pa.RecordBatch, width: int, k: int, same: bool, share: tuple[int, int] | None) -> Iterator[tuple]:
    """The k best rows of the block for each query of ``asked`` and each of its positives."""
    qv = matrix(asked.column("v"), width)
    planes = Planes(qv.astype(float))
    positives = asked.column("positives").to_pylist()
    for first in range(0, len(qv), BATCH):
        some = slice(first, min(first + BATCH, len(qv)))
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for a in range(0, len(block.ids), CHUNK):
            part = slice(a, a + CHUNK)
            estimate, cut = 0.0, 0.0
            for r in range(DENSE):
                estimate = estimate + planes.product(r, block.codes[part, r], some) * block.aligned[part, r]
                cut = cut + planes.rounds[r][4][some, None] * block.aligned[part, r]
            for i in range(some.start, some.stop):
                qid, label = asked.column("id")[i].as_py(), asked.column("label")[i].as_py()
                may = block.ids[part] != qid
                may &= (block.labels[part] == label) == same
                at = np.flatnonzero(may)
                mid, loss = estimate[i - first, at], cut[i - first, at]
                bands = ranges(positives[i], share)
                at = a + at
                for r in range(DENSE, ROUNDS + 1):
                    slack = planes.norm[i] * (block.rest[at, r - 1] + 1e-9 * block.norm[at]) + loss * (1 + 1e-9) + 1e-6
                    low, high = mid - slack, mid + slack
                    stay = np.zeros(len(at), bool)
                    for b, (_, _, least, greatest) in enumerate(bands):
                        # the k-th best of scores seen, or sure to lie in the range, is a bar
                        sure = low[(low >= least) & (high <= greatest)]
                        seen = found.get((i, b), (None, np.empty(0, np.int64)))[1]
                        bar = least
                        if len(seen) == k:
                            bar = max(bar, int(seen[-1]))
                        if len(sure) >= k:
                            bar = max(bar, np.partition(sure, len(sure) - k)[len(sure) - k])
                        stay |= (high >= bar) & (low <= greatest)
                    at, mid, loss = at[stay], mid[stay], loss[stay]
                    if r < ROUNDS:
                        mid = mid + planes.product(r, block.codes[at, r], i) * block.aligned[at, r]
                        loss = loss + planes.rounds[r][4][i] * block.aligned[at, r]
                score = integer_scores(block.v[at], qv[i], block.most)
                for b, (_, _, least, greatest) in enumerate(bands):
                    good = (score >= least) & (score <= greatest)
                    ids, scores = found.get((i, b), (np.empty(0, np.int64), np.empty(0, np.int64)))
                    found[i, b] = best(np.append(ids, block.ids[at][good]), np.append(scores, score[good]), k)
        for (i, b), (ids, scores) in found.items():
            positive, value, *_ = ranges(positives[i], share)[b]
            qid = asked.column("id")[i].as_py()
            yield from ((qid, b, positive, value, int(x), int(s)) for x, s in zip(ids, scores, strict=True))


# search on all rows


def coded(rows: DataFrame, width: int) -> DataFrame:
    """Add the codes and their alignments and rests to ``row``, ``id``, ``label``, ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                part = batch.slice(a, CHUNK)
                codes, aligned, rest = encode(matrix(part.column("v"), width).astype(float))
                scales = pa.array(np.concatenate([aligned, rest], axis=1).tolist(), pa.list_(pa.float64()))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed, scales], [*part.schema.names, "codes", "scales"])

    return rows.mapInArrow(run, "row long, id long, label long, v array<long>, codes binary, scales array<double>")


def best_in_range(queries: DataFrame, rows: DataFrame, width: int, k: int, same: bool, share: tuple[int, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows for each query and positive: ``query_id``, ``pos``, the positive, ``id``, ``score``, ``rank``.

    ``rows`` are of the same label as the query if ``same``, else of another.  With ``share`` (percent of
    the positive's score, least and greatest) scores lie in that range of each of its ``positives``.
    """
    n = rows.count()
    blocks = max(1, -(-n // block_rows), min(shuffle_slices(rows.sparkSession), n // LEAST_ROWS))
    none = lambda kind: F.lit(None).cast(kind)
    kind = "array<struct<id:long,score:long>>"
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "label", "v", "codes", "scales", none(kind).alias("positives"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asking = queries.select(every, F.lit(1).alias("asks"), "id", "label", "v", none("binary").alias("codes"), none("array<double>").alias("scales"), F.col("positives").cast(kind).alias("positives"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            key = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key[a] // 2 != number:
                    number, held, block = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                block = block or Block(held, width)
                out = list(zip(*search(block, part, width, k, same, share), strict=True))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    names = ["query_id", "pos", "positive_id", "positive_score", "id", "score"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    met = dealt.unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id", "pos").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    label: Column | None = None,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    share: tuple[int, int] = (30, 90),
    scale: int = 256,
    vector: str = "embedding",
    ident: str = "vec_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Negatives of each anchor (identifier divisible by ``every``) and each of its best ``positives``.

    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``;
    ``share`` gives the least and the greatest percentage of the positive's score.
    """
    label = F.col("label") if label is None else label
    v = scaled(F.col(vector), scale)
    rows = vectors.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = durable(rows.select(F.monotonically_increasing_id().alias("row"), "*"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    width = 64
    while width < longest:
        width *= 2
    stored = durable(coded(rows, width))
    anchors = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.*")
    near = best_in_range(anchors.withColumn("positives", F.lit(None)), stored, width, positives, same=True, block_rows=block_rows)
    lists = near.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    lists = lists.select("id", F.transform("p", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    asked = durable(anchors.join(lists, "id"))
    far = best_in_range(asked, stored, width, negatives, same=False, share=share, block_rows=block_rows)
    return far.select(
        F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
