"""Ranked lexical search by dense tiles of an item vocabulary and document impacts.

Items are taken in blocks of bounded size.  Of a block the distinct terms are numbered, the most
frequent first, and sent to the tasks.  One pass over all whole texts counts, for each document, its terms and
the occurrences of the numbered ones; numbers of documents, lengths and document frequencies are sums
over that pass.  A second pass over those counts fills tiles: ``TILE`` documents by a slice of the
vocabulary, as float64, and multiplies each with the weights of the items in that slice (BLAS).  A slice
ends before a sum of products could reach 2 ** 53, so every partial sum is an exact integer; slices are
added as 64-bit integers.  A slice without a term of the tile's documents is skipped.  Of each tile an item keeps its k best; where the k-th score is tied, the smaller
identifiers stay.  Each task returns k rows for each item.

Cases: null texts have no term and never match.  A null document identifier comes last among equal
scores.  Rows that repeat a document identifier are documents of their own, with a rank each.  Items that
repeat an identifier are one item with the terms of all of them; items without a term, and a null
identifier, follow the same rules.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.llm.common import texts_of
from oscilla.session import durable

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS, BLOCK_ITEMS = 20_000, 256  # terms of all items of a block together, and its items
TILE, COLUMNS = 1024, 4096
EXACT = 2**53
SCALE, K_TERM, K_LENGTH = 1_000_000_000, 1000, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# every byte of a term stays (capitals as small letters), all others become a space
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def item_terms(items: DataFrame, ident: str, text: str) -> DataFrame:
    """Distinct ``item``, ``term`` (null for an item without any)."""
    small = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return items.select(F.col(ident).alias("item"), F.explode_outer(F.array_distinct(F.regexp_extract_all(small, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def counted(docs: DataFrame, vocabulary: dict[bytes, int], ident: str, text: str) -> DataFrame:
    """``id``, ``n`` (terms with repeats), and ``terms`` and ``tf`` of the vocabulary, of each document with a term."""
    terms = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value.get
        for batch in batches:
            ids, n, which, tf = [], [], [], []
            for i, text_ in enumerate(texts_of(batch.column(1))):
                found = terms_of(text_)
                if not found:
                    continue
                hits = [(v, c) for t, c in Counter(found).items() if (v := number(t)) is not None]
                ids.append(i)
                n.append(len(found))
                which.append([v for v, _ in hits])
                tf.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                ["id", "n", "terms", "tf"],
            )

    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """(SCALE * tf) div (1000 * tf + 8 * m) of the occurrences ``tf`` in documents of ``n`` terms."""
    if len(n) and 90 * int(n.max()) * n_docs < 2**62 and SCALE * int(tf.max(initial=0)) < 2**62:
        m = 10 + 90 * n * n_docs // length
        return SCALE * tf // (K_TERM * tf + K_LENGTH * m)
    return np.array([SCALE * t // (K_TERM * t + K_LENGTH * (10 + 90 * x * n_docs // length)) for t, x in zip(tf.tolist(), n.tolist(), strict=True)], np.int64)


Slice = tuple[int, int, np.ndarray, np.ndarray]


def slices_of(item: np.ndarray, term: np.ndarray, weights: np.ndarray, columns: int = COLUMNS) -> list[Slice]:
    """Vocabulary slices (first term, end, items, weights of item by term) of the uses ``item``, ``term``.

    Impacts are under ``SCALE / 1000``, so a slice ends before the weights of an item times that reach
    2 ** 53.  It holds only the items that use one of its terms.
    """
    order = np.lexsort((item, term))
    item, term = item[order], term[order]
    edges = np.searchsorted(term, np.arange(len(weights) + 1))
    cuts, held = [0], Counter()
    for t, w in enumerate(weights.tolist()):
        mine = item[edges[t] : edges[t + 1]].tolist()
        if t - cuts[-1] == columns or any((held[i] + w) * (SCALE // K_TERM) >= EXACT for i in mine):
            cuts.append(t)
            held = Counter()
        held.update(dict.fromkeys(mine, w))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(weights)], strict=True):
        here = slice(edges[a], edges[b])
        items, row = np.unique(item[here], return_inverse=True)
        dense = np.zeros((len(items), b - a))
        dense[row, term[here] - a] = weights[term[here]]
        out.append((a, b, items, dense))
    return out


class Best:
    """The k best documents of each item so far; a null identifier counts as greater than any other."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((items, 0), np.int64)
        self.ids = np.zeros((items, 0), np.int64)
        self.null = np.zeros((items, 0), bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate([self.score, score], axis=1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (len(score), len(ids)))], axis=1)
        null = np.concatenate([self.null, np.broadcast_to(null, (len(score), len(null)))], axis=1)
        if score.shape[1] > self.k:
            bar = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
            keep = np.empty((len(score), self.k), np.int64)
            for i, b in enumerate(bar):
                at = np.flatnonzero(score[i] >= max(b, 1))  # all ties of the k-th; a score of 0 matters to nobody
                at = at[np.lexsort((ids[i, at], null[i, at], -score[i, at]))][: self.k]
                short = self.k - len(at)
                if short:
                    at = np.append(at, np.flatnonzero(score[i] <= 0)[:short])
                keep[i] = at
            score, ids, null = (np.take_along_axis(x, keep, axis=1) for x in (score, ids, null))
        self.score, self.ids, self.null = score, ids, null


def ranked_block(
    counts: DataFrame, item: np.ndarray, term: np.ndarray, weights: np.ndarray, n_docs: int, length: int, k: int, tile: int = TILE, columns: int = COLUMNS
) -> DataFrame:
    """``at`` (number of the item), ``id`` and ``score`` of the k best documents of each task."""
    sent = counts.sparkSession.sparkContext.broadcast((item, term, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, weights = sent.value
        parts = slices_of(item, term, weights, columns)
        n_items = int(item.max()) + 1
        best = Best(n_items, k)
        for whole in batches:
            for a in range(0, len(whole), tile):
                batch = whole.slice(a, tile)
                ids, n = batch.column("id"), batch.column("n").to_numpy()
                terms, tf = np.asarray(batch.column("terms").flatten()), np.asarray(batch.column("tf").flatten())
                row = np.repeat(np.arange(len(n)), np.diff(np.asarray(batch.column("terms").offsets)))
                impact = impacts(tf, n[row], n_docs, length)
                score = np.zeros((n_items, len(n)), np.int64)
                order = np.argsort(terms, kind="stable")
                for first, end, users, part in parts:
                    at = order[slice(*np.searchsorted(terms, [first, end], sorter=order))]
                    if len(at):
                        dense = np.zeros((end - first, len(n)))
                        dense[terms[at] - first, row[at]] = impact[at]
                        score[users] += (part @ dense).astype(np.int64)
                best.add(score, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))
        who, place = np.nonzero(best.score > 0)
        ids = pa.array(best.ids[who, place], mask=best.null[who, place])
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), ids, pa.array(best.score[who, place])], ["at", "id", "score"])

    return counts.mapInArrow(run, "at int, id long, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    ident: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
    block_items: int = BLOCK_ITEMS,
    tile: int = TILE,
    columns: int = COLUMNS,
) -> DataFrame:
    """``item``, ``rank`` from 1, ``id`` and ``score`` of the k best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    pairs = durable(item_terms(items, item, item_text))
    uses, known = pairs.agg(F.count(F.lit(1)), F.countDistinct("item")).first()
    blocks = max(1, -(-uses // block_terms), -(-known // block_items))
    results = []
    for number in range(blocks):
        mine = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        rows = mine.filter("term IS NOT NULL").collect()  # about block_terms rows, or the terms of one item
        if not rows:
            continue
        held = Counter(r["term"] for r in rows)
        vocabulary = {t: v for v, (t, _) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0])))}
        names = sorted({r["item"] for r in rows}, key=lambda x: (x is None, x))
        counts = durable(counted(docs, {t.encode(): v for t, v in vocabulary.items()}, ident, text))
        n_docs, length = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(n_docs, df.get(v, 0)) for v in range(len(vocabulary))], np.int64)
        place = {name: i for i, name in enumerate(names)}
        used = np.array([(place[r["item"]], vocabulary[r["term"]]) for r in rows], np.int64)
        best = ranked_block(counts, used[:, 0], used[:, 1], weights, n_docs, length, k, tile, columns)
        named = spark.createDataFrame(list(enumerate(names)), f"at int, item {pairs.schema['item'].dataType.simpleString()}")
        order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        results.append(durable(best.join(F.broadcast(named), "at").select("item", "rank", "id", "score")))
    if not results:
        return pairs.select("item", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).filter("false")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
