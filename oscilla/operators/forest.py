"""Random forest for classification over any number of rows, grown level by level from histograms.

Features are cut into bins first, so a row is a few bytes.  For each level of all trees a task counts its rows by
tree, node, drawn feature, bin and class; the counts of the tasks are added up in a shuffle, and each node takes the
split with the greatest Gini gain.  A node has its features drawn anew.  The bootstrap weight of a row in a tree
(Poisson of mean 1, to 16 bits) and the features of a node are functions of the seed, so nothing of a row has to be kept
between levels, and the result doesn't depend on partitions or their order.  The forest comes to the driver, a table
of fixed size; rows never do.

As in MLlib, a node is a leaf at the greatest depth, if it is pure, or if no split gains; sibling leaves of the
same class are merged; the importance of a feature is the sum of gain times weight over its splits, to 1 in each
tree and then over all trees.

Cases: rows with a null or NaN feature or label are left out.  Classes are 0, 1, ... up to the greatest label.
A feature of at most ``BINS`` values (of those that hold a thousandth of the rows) is cut between all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.session import durable

BINS = 32
HELD = 1 << 20  # rows that a task counts at once
BLOCK = 1 << 15  # rows that a kernel takes at once
NODES = 64  # nodes whose counts make one row of the shuffle
RANKS = 1_000


def cuts_of(quantiles: Sequence[float]) -> np.ndarray:
    """At most ``BINS`` - 1 increasing thresholds from many quantiles of a feature; a value up to the first is in bin 0."""
    values = np.unique(quantiles)
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.asarray(quantiles)[np.arange(1, BINS) * len(quantiles) // BINS])


def binned(df: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, int]:
    """Complete rows as a number ``id``, class ``y`` and the bins ``x0``, ``x1``, ... of the features; and how many classes."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y")).na.drop()
    ranks = F.array(*[F.lit(i / RANKS) for i in range(RANKS + 1)])
    row = data.agg(
        F.count(F.lit(1)).alias("n"), F.max("_y").alias("y"), F.array(*[F.percentile_approx(c, ranks, 10_000) for c in features]).alias("q")
    ).first()
    if not row["n"]:
        raise ValueError("no complete rows to learn from")
    cuts = [cuts_of(q) for q in row["q"]]
    names = ["id", "y", *[f"x{j}" for j in range(len(features))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [pa.array(np.searchsorted(c, batch.column(j).to_numpy()).astype(np.int8)) for j, c in enumerate(cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(len(cuts)), batch.column(len(cuts) + 1).cast(pa.int32()), *bins], names)

    # a row has its number from where it stands; it is written, so the number stays
    numbered = data.select(*features, F.monotonically_increasing_id().alias("id"), F.col("_y").cast("int").alias("y"))
    made = numbered.mapInArrow(run, ", ".join(["id long", "y int", *[f"{c} byte" for c in names[2:]]]))
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-row["n"] // HELD), min(cores, -(-row["n"] // BLOCK)))
    return durable(made.repartition(parts)), int(row["y"]) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson() -> np.ndarray:
    """Value of a Poisson variable of mean 1 for each 16 random bits."""
    reached = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(reached, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def weights(ids: np.ndarray, seed: int, four: int, table: np.ndarray) -> np.ndarray:
    """Bootstrap weights of rows in four trees that follow each other."""
    start = np.uint64(np.random.default_rng([seed, four]).integers(1 << 63))
    with np.errstate(over="ignore"):
        bits = _mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start)
    return table[bits.view(np.uint16).reshape(-1, 4)]


def drawn(seed: int, tree: int, level: int, features: int, taken: int) -> np.ndarray:
    """The features that each node of a level may be split by."""
    order = np.random.default_rng([seed, tree, level, 1]).random((1 << level, features))
    return np.sort(np.argsort(order, axis=1)[:, :taken], axis=1)


def nodes_of(x: np.ndarray, base: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Node of a level that rows come to, which begin at ``base`` in the bins ``x``."""
    node = np.zeros(len(base), np.int64)
    for d in range(level):
        place = node + ((1 << d) - 1)
        node = 2 * node + (x.take(base + feature.take(place)) > cut.take(place))
    return node


def best_splits(counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """From counts by drawn feature, node, bin and class: the nodes with a split that gains, its feature, cut and gain, and the classes on both sides."""

    def gini(c: np.ndarray) -> np.ndarray:
        n = c.sum(axis=-1)
        return 1 - (c * c).sum(axis=-1) / np.maximum(n, 1) ** 2

    left = np.cumsum(counts, axis=2)[:, :, :-1].transpose(1, 0, 2, 3)  # by node, feature, cut and class
    whole = counts[0].sum(axis=1)
    right = whole[:, None, None] - left
    nl, nr = left.sum(axis=-1), right.sum(axis=-1)
    n = np.maximum(nl + nr, 1)
    gain = gini(whole)[:, None, None] - nl / n * gini(left) - nr / n * gini(right)
    gain = np.where((nl > 0) & (nr > 0), gain, -np.inf).reshape(len(whole), -1)
    best = gain.argmax(axis=1)
    node = np.flatnonzero(gain[np.arange(len(whole)), best] > 0)
    best = best[node]
    j, cut = best // (counts.shape[2] - 1), best % (counts.shape[2] - 1)
    return node, chosen[node, j], cut, gain[node, best], left[node, j, cut], right[node, j, cut]


def level_splits(rows: DataFrame, model: tuple[np.ndarray, ...], level: int, classes: int, taken: int, seed: int) -> DataFrame:
    """The best split of each open node of a level of all trees."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    trees, features = len(model[0]), len(rows.columns) - 2
    size = 1 << level

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, cut, opened = sent.value
        rows_ = pa.Table.from_batches(held)
        ids, y = rows_.column(0).to_numpy(), rows_.column(1).to_numpy().astype(np.int64)
        x = np.stack([c.to_numpy().view(np.uint8) for c in rows_.columns[2:]], axis=1).ravel()
        table = poisson()
        for four in range(-(-trees // 4)):
            own = range(4 * four, min(4 * four + 4, trees))
            chosen = [drawn(seed, t, level, features, taken) for t in own]
            sums = np.zeros((len(own), taken, size * BINS * classes))
            for a in range(0, len(ids), BLOCK):
                times = weights(ids[a : a + BLOCK], seed, four, table)
                for i, t in enumerate(own):
                    at = np.flatnonzero(times[:, i])
                    base = (at + a) * features
                    node = nodes_of(x, base, feature[t], cut[t], level)
                    alive = opened[t].take(node)
                    if not alive.all():
                        at, base, node = at[alive], base[alive], node[alive]
                    cell, w = node * (BINS * classes) + y[a : a + BLOCK].take(at), times[:, i].take(at).astype(np.float64)
                    for j in range(taken):
                        bins = x.take(base + chosen[i][:, j].take(node))
                        sums[i, j] += np.bincount(cell + bins * np.int64(classes), w, sums.shape[2])
            for i, t in enumerate(own):
                yield packed(t, sums[i].reshape(taken, size, BINS, classes), opened[t])

    def packed(tree: int, counts: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
        chunks = [c for c in range(-(-size // NODES)) if opened[c * NODES : (c + 1) * NODES].any()]
        widths, cells = [], []
        for c in chunks:
            part = counts[:, c * NODES : (c + 1) * NODES]
            widths.append(next(b for b in (1, 2, 4, 8) if b == 8 or part.max() < 1 << (8 * b)))
            cells.append(part.astype(f"u{widths[-1]}").tobytes())
        columns = [pa.array([tree] * len(chunks), pa.int32()), pa.array(chunks, pa.int32()), pa.array(widths, pa.int32()), pa.array(cells, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["tree", "chunk", "width", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield from counted(held)
                held, n = [], 0
        if n:
            yield from counted(held)

    def settled(tree: int, chunk: int, counts: np.ndarray) -> pa.RecordBatch:
        node, *found, left, right = best_splits(counts, drawn(seed, tree, level, features, taken)[chunk * NODES : (chunk + 1) * NODES])
        numbers = [np.full(len(node), tree), node + chunk * NODES, *found]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        sides = [pa.array(list(s), pa.list_(pa.float64())) for s in (left, right)]
        return pa.RecordBatch.from_arrays([*[pa.array(v, k) for v, k in zip(numbers, kinds, strict=True)], *sides], ["tree", "node", "feature", "cut", "gain", "left", "right"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by tree and chunk, so one sum is held
        last, total = None, np.zeros(0)
        for batch in batches:
            for tree, chunk, width, cells in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (tree, chunk) != last:
                    if last:
                        yield settled(*last, total)
                    last, total = (tree, chunk), np.zeros((taken, min(NODES, size), BINS, classes))
                total += np.frombuffer(cells, f"u{width}").reshape(total.shape)
        if last:
            yield settled(*last, total)

    made = rows.mapInArrow(count, "tree int, chunk int, width int, cells binary")
    dealt = made.repartition(max(1, trees * -(-size // NODES) // 16), "tree", "chunk").sortWithinPartitions("tree", "chunk")
    return dealt.mapInArrow(settle, "tree int, node int, feature int, cut int, gain double, left array<double>, right array<double>")


def importances(rows: DataFrame, classes: int, trees: int = 200, depth: int = 10, seed: int = 42) -> np.ndarray:
    """Importance of each feature of the ``rows`` that ``binned`` makes, in a forest grown on all of them."""
    features = len(rows.columns) - 2
    taken, inner = math.ceil(math.sqrt(features)), (1 << depth) - 1
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.uint8)
    split, worth = np.zeros((trees, 2 * inner + 1), bool), np.zeros((trees, inner))
    vote = np.zeros((trees, 2 * inner + 1), np.int64)
    opened = np.ones((trees, 1), bool)
    for level in range(depth):
        found = level_splits(rows, (feature, cut, opened), level, classes, taken, seed).toArrow()
        opened = np.zeros((trees, 2 << level), bool)
        if not found.num_rows:
            break
        t, node, f, c, gain = (found.column(i).to_numpy() for i in range(5))
        place = node + ((1 << level) - 1)
        feature[t, place], cut[t, place], split[t, place] = f, c, True
        sides = [np.array(found.column(i).to_pylist()) for i in (5, 6)]
        worth[t, place] = gain * (sides[0] + sides[1]).sum(axis=1)
        for right, side in enumerate(sides):
            vote[t, 2 * place + 1 + right] = side.argmax(axis=1)
            opened[t, 2 * node + right] = (side > 0).sum(axis=1) > 1
        if not opened.any():
            break
    for level in reversed(range(depth)):  # leaves of the same parent and class are one
        here = np.arange((1 << level) - 1, (2 << level) - 1)
        left, right = 2 * here + 1, 2 * here + 2
        split[:, here] &= split[:, left] | split[:, right] | (vote[:, left] != vote[:, right])
    out = np.zeros(features)
    for t in range(trees):
        own = np.bincount(feature[t], np.where(split[t, :inner], worth[t], 0.0), features)
        out += own / own.sum() if own.sum() else 0.0
    return out / out.sum() if out.sum() else out
