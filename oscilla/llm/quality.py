"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is lower-cased and cut into words and runs of marks.  Its features are the hashes of single
tokens and of neighbouring pairs; a token that follows itself is one shared feature instead of a pair,
so that plain repetition is learnt whatever is repeated.  A feature's value is its count divided by
the square root of the number of tokens, so a score is a sparse dot product that needs one pass.

The fit reads a bounded, hash-chosen sample of the labelled rows (``at_most``), in one task; scoring
reads every text and needs no shuffle.  The weights, 2 ** ``bits`` floats, are the only broadcast.

Cases: null and empty texts have no features and get the score of the bias.  Rows without a label or
an identifier aren't learnt from.  Of contrary labels of one identifier the least counts; rows that repeat
an identifier are all learnt from.  An empty table gives an empty result.  Texts of any length are scored whole.  If there is nothing to learn
from, every score is 0.5.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.llm.common import hash_sample, held_fold, texts_of

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS, PAIR, SAME = 18, np.uint64(0x9E3779B97F4A7C15), 1
MAX_ROWS = 20_000
MEMO = 200_000

_codes: dict[str, int] = {}


def _coded(tokens: list[str]) -> np.ndarray:
    """A number for each token, remembered per worker; the memory starts anew when it is full."""
    if len(_codes) > MEMO:
        _codes.clear()
    for t in set(tokens).difference(_codes):
        _codes[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Feature of every token and pair of tokens of a text, and the value of one occurrence."""
    tokens = TOKEN.findall(text.lower())
    if not tokens:
        return np.zeros(0, np.int64), 0.0
    codes = _coded(tokens)
    with np.errstate(over="ignore"):
        pairs = (codes[:-1] * PAIR) ^ (codes[1:] + np.uint64(0x85EBCA6B))
        pairs[codes[:-1] == codes[1:]] = SAME
        mixed = np.concatenate([codes, pairs]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64), 1 / math.sqrt(len(tokens))


def example(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their values; the last feature is the bias."""
    at, value = features(text, bits)
    at, counts = np.unique(at, return_counts=True)
    return np.append(at, 1 << bits).astype(np.int32), np.append(counts * value, 1.0).astype(np.float32)


def train(
    examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3
) -> np.ndarray:
    """Weights after ``epochs`` passes of per-coordinate FTRL-proximal; the last one is the bias.

    Both labels count alike in all, whatever their share.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    ones = sum(y for *_, y in examples)
    balance = {1: len(examples) / (2 * max(ones, 1)), 0: len(examples) / (2 * max(len(examples) - ones, 1))}
    for _ in range(epochs):
        for at, x, y in examples:
            w = weight(at)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x)))))
            g = (p - y) * x.astype(np.float64) * balance[y]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weight(np.arange(size)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", ident: str = "doc_id", at_most: int = MAX_ROWS) -> np.ndarray:
    """Train on at most about ``at_most`` labelled rows; ``labels`` has ``ident`` and ``label``.

    Features are found where the texts are; the one task that trains reads only those.
    """
    known = hash_sample(labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull()), F.col(ident), at_most)
    known = known.select(F.col(ident).alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.min("y").alias("y"))
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(known, "id")
    rows = rows.select(F.crc32(F.col("id").cast("string").cast("binary")).alias("key"), F.xxhash64("text").alias("tie"), "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [example(t) for t in texts_of(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))],
                ["key", "tie", "y", "at", "x"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for at, x, y in zip(batch.column(3), batch.column(4), batch.column(2).to_pylist(), strict=True):
                examples.append((at.values.to_numpy(), x.values.to_numpy(), y))
        if examples:
            yield pa.RecordBatch.from_arrays([pa.array([train(examples).tobytes()], pa.binary())], ["weights"])

    made = rows.mapInArrow(extract, "key long, tie long, y int, at array<int>, x array<float>")
    # the order of learning is fixed by a hash, not by where rows come from
    found = made.repartition(1).sortWithinPartitions("key", "tie").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def scorer(spark: SparkSession, weights: np.ndarray, bits: int = BITS):
    """A column function that scores texts: the probability of label 1."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value.astype(np.float64)
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                at, value = features(t or "", bits)
                out[i] = float(w[at].sum()) * value + w[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def training_labels(labels: DataFrame, held: int = 1, folds: int = 3, ident: str = "doc_id") -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.filter(held_fold(F.col(ident), folds) != held)


def quality_score(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", ident: str = "doc_id") -> Column:
    """Column expression with the score of each text of ``docs``."""
    weights = fit(docs, training_labels(labels, ident=ident), label, text, ident)
    return scorer(docs.sparkSession, weights)(F.col(text))


def drop_poor(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` whose score is at least ``at_least``, with their own columns."""
    return docs.filter(quality_score(docs, labels, text=text) >= at_least)
