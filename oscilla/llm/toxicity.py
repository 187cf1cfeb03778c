"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fit, on a bounded, hash-chosen sample of the labelled rows (``at_most``): the words and
beginnings of words most associated with the label (chi-squared over documents, at most ``terms``, and
none that explains less than ``LEAST_SHARE`` of it) form the vocabulary; document
frequencies for the inverse weights are counted over all documents; the examples go into an inverted
index whose postings are cut into blocks of examples with the largest weight of each term in each block.
The index is bounded by its two parameters and is the only broadcast.

Scoring reads every whole text: the bound of a block is the sum of the text's weights times the block's
largest weights.  The most promising blocks are scored first; a block is skipped only if its bound is
below the k-th best cosine found, so the neighbours are exact.  Ties go to the smaller example number.
Neighbours vote with their cosine; examples that share no term have cosine zero and no vote, and a
pseudo-vote for label 0 stands against chance likenesses.  The share of the vote is mapped to a probability by a logistic curve fitted on the
examples, each scored without itself.

Cases: null and empty texts, and texts without a term of the vocabulary, have no neighbours and get
the score of an empty vote.  Rows without a label or an identifier aren't learnt from.  Of contrary labels
of one identifier the least counts.  Texts that share an identifier are examples of their own, a text that
repeats is one, under its least identifier.  An empty table gives an empty result; with no
example of either label every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from oscilla.llm.common import hash_sample, held_fold, texts_of

WORD = re.compile(r"[^\W\d_]+")
MAX_EXAMPLES, MAX_TERMS, BLOCK, NEIGHBOURS = 20_000, 256, 64, 15
# terms that explain less of the label than this share of its variance are left out beyond the first few:
# copies of single documents make them look significant
LEAST_TERMS, LEAST_SHARE, CANDIDATES = 5, 0.01, 16
STEMS, MEMO = (3, 4, 5, 6, 7), 500_000
PSEUDO = 0.5


def units(word: str) -> list[str]:
    """A word and its longer beginnings, so that a stem is one term whatever endings it takes."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


class Vocabulary(dict):
    """Terms of each word, found when the word is first met; the memory starts anew when it is full."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = tuple(n for n in map(self.number.get, units(word)) if n is not None)
        return found

    def counts(self, text: str) -> dict[int, int]:
        """How often each term occurs in a text."""
        return Counter(chain.from_iterable(map(self.__getitem__, WORD.findall(text.lower()))))


@dataclass(frozen=True)
class Index:
    """Block-max inverted index over the examples."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray  # where the postings of (term, block) start, one row per term
    docs: np.ndarray
    weights: np.ndarray
    peak: np.ndarray  # the largest weight of (term, block)
    block: int = BLOCK

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.vocabulary.counts(text)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        terms = np.fromiter(found.keys(), np.int64, len(found))
        order = np.argsort(terms)
        tf = np.fromiter(found.values(), np.float64, len(found))[order]
        w = (1 + np.log(tf)) * self.idf[terms[order]]
        return terms[order], w / math.sqrt(float(w @ w))

    def _scores(self, terms: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of all examples in ``blocks`` that share a term."""
        a, b = self.start[terms][:, blocks], self.start[terms][:, blocks + 1]
        n = (b - a).ravel()
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a.ravel() - (ends - n), n)
        docs, inverse = np.unique(self.docs[at], return_inverse=True)
        part = self.weights[at] * np.repeat(np.repeat(w, len(blocks)), n)
        return docs, np.bincount(inverse, weights=part, minlength=len(docs))

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine, all of them above zero, best first."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = w @ self.peak[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        best_docs, best, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while done < len(order):
            if len(best) >= k:
                bar = best[k - 1] - 1e-9
                if bound[order[done]] < bar:
                    break
                take = order[done : done + step]
                take = take[bound[take] >= bar]
            else:
                take = order[done : done + step]
            docs, scores = self._scores(terms, w, np.sort(take))
            keep = docs != without
            docs, scores = np.concatenate([best_docs, docs[keep]]), np.concatenate([best, np.round(scores[keep], 9)])
            top = np.lexsort((docs, -scores))[:k]
            best_docs, best = docs[top], scores[top]
            done, step = done + step, step * 4
        return best_docs, best

    def vote(self, docs: np.ndarray, scores: np.ndarray) -> float:
        """Share of the label 1 in the votes and the pseudo-vote."""
        ones = float(scores[self.labels[docs] == 1].sum())
        return ones / (float(scores.sum()) + PSEUDO)


def build(number: dict[str, int], df: np.ndarray, total: int, examples: list[tuple[int, dict[int, int], int]], block: int = BLOCK) -> Index:
    """Index of examples (id, term counts, label); those alike in their rarest term share blocks."""
    idf = np.log((1 + total) / (1 + df)) + 1
    vectors = []
    for i, found, y in examples:
        terms = np.array(sorted(found), np.int64)
        w = (1 + np.log(np.array([found[t] for t in terms.tolist()], float))) * idf[terms] if len(terms) else np.zeros(0)
        vectors.append((i, y, terms, w / math.sqrt(float(w @ w)) if len(w) else w))
    vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]) if len(v[2]) else len(number), -(v[3].max() if len(v[3]) else 0), v[0]))
    blocks = -(-len(vectors) // block)
    terms = np.concatenate([v[2] for v in vectors]) if vectors else np.zeros(0, np.int64)
    docs = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
    weights = np.concatenate([v[3] for v in vectors]) if vectors else np.zeros(0)
    order = np.lexsort((docs, terms))
    terms, docs, weights = terms[order], docs[order], weights[order]
    cell = terms * (blocks + 1) + docs // block if len(terms) else terms
    grid = np.arange(len(number))[:, None] * (blocks + 1) + np.arange(blocks + 1)[None, :]
    start = np.searchsorted(cell, grid)
    peak = np.zeros((len(number), max(blocks, 1)))
    if len(terms):
        np.maximum.at(peak, (terms, docs // block), weights)
    return Index(
        Vocabulary(number), idf, np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors], np.int64), start, docs, weights, peak, block
    )


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton's method."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - y) + 1e-3 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(beta[0]), float(beta[1])


def choose_terms(examples: DataFrame, terms: int) -> list[str]:
    """The terms of highest chi-squared with the label, by the documents they occur in (at least 3)."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            labels = batch.column(1).to_pylist()
            for t, y in zip(texts_of(batch.column(0)), labels, strict=True):
                for word in {u for w in set(WORD.findall(t.lower())) for u in units(w)}:
                    seen.setdefault(word, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())],
                ["word", "zeros", "ones"],
            )

    sizes = examples.groupBy().agg(F.sum(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    n, ones = sizes["n"] or 0, sizes["y"] or 0
    if not 0 < ones < n:
        return []
    counted = examples.select("text", "y").mapInArrow(words, "word string, zeros long, ones long")
    counted = counted.groupBy("word").agg(F.sum("zeros").alias("c"), F.sum("ones").alias("a")).filter("a + c >= 3")
    a, c, b, d = F.col("a").cast("double"), F.col("c").cast("double"), F.lit(float(ones)) - F.col("a"), F.lit(float(n - ones)) - F.col("c")
    chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * F.greatest(b + d, F.lit(1.0)))
    top = counted.select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(CANDIDATES * terms).collect()
    strong = {r["word"]: r["chi"] for i, r in enumerate(top) if i < LEAST_TERMS or r["chi"] >= LEAST_SHARE * n}
    return sorted(sorted(best_of_stems(strong), key=lambda w: (-strong[w], w))[:terms])


def best_of_stems(strong: dict[str, float]) -> list[str]:
    """Terms that are stronger than every beginning of theirs, and that no term they begin surpasses."""
    kept: list[str] = []
    for word in sorted(strong, key=lambda w: (-strong[w], -len(w.rstrip("*")), w)):
        bare = word.rstrip("*")
        if not any(bare.startswith(k.rstrip("*")) if k.endswith("*") else word.endswith("*") and k.startswith(bare) for k in kept) and not any(
            word.endswith("*") and k.rstrip("*").startswith(bare) for k in kept
        ):
            kept.append(word)
    return kept


def document_frequencies(docs: DataFrame, number: dict[str, int], text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df, vocabulary = 0, np.zeros(len(number), np.int64), Vocabulary(number)
        for batch in batches:
            for t in texts_of(batch.column(0)):
                df[list(vocabulary.counts(t))] += 1
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(number))), pa.array(np.append(total, df))], ["term", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in sums}
    return np.array([by.get(t, 0) for t in range(len(number))], np.int64), by.get(-1, 0)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", ident: str = "doc_id", at_most: int = MAX_EXAMPLES, terms: int = MAX_TERMS, k: int = NEIGHBOURS
) -> tuple[Index, float, float]:
    """Index of the examples, and slope and intercept of the calibration."""
    known = hash_sample(labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull()), F.col(ident), at_most)
    known = known.select(F.col(ident).alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.min("y").alias("y"))
    examples = docs.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(known, "id")
    # a text that was labelled several times is one example
    examples = examples.groupBy("text").agg(F.min(F.struct("id", "y")).alias("e")).select("e.id", "text", "e.y")
    words = choose_terms(examples, terms)
    number = {w: i for i, w in enumerate(words)}
    df, total = document_frequencies(docs, number, text)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(number)
        for batch in batches:
            found = [vocabulary.counts(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                ["id", "y", "terms", "tf"],
            )

    schema = StructType().add("id", examples.schema["id"].dataType).add("y", "integer").add("terms", ArrayType(IntegerType())).add("tf", ArrayType(IntegerType()))
    rows = examples.select("id", "text", "y").mapInArrow(counts, schema).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["terms"], r["tf"]))
    numbered = build(number, df, total, [(n, dict(zip(r["terms"], r["tf"], strict=True)), r["y"]) for n, r in enumerate(rows)])
    index = replace(numbered, ids=np.array([rows[n]["id"] for n in numbered.ids]))
    if not rows or not 0 < index.labels.sum() < len(rows):
        return index, 0.0, -30.0
    votes, truth = [], []
    for at in np.argsort(numbered.ids):  # the place of each row in the index
        r, me = rows[numbered.ids[at]], int(at)
        t = np.array(sorted(r["terms"]), np.int64)
        tf = dict(zip(r["terms"], r["tf"], strict=True))
        w = (1 + np.log(np.array([tf[i] for i in t.tolist()], float))) * index.idf[t] if len(t) else np.zeros(0)
        w = w / math.sqrt(float(w @ w)) if len(w) else w
        votes.append(index.vote(*index.nearest(t, w, k, without=me)))
        truth.append(r["y"])
    slope, intercept = logistic(np.array(votes), np.array(truth))
    return index, slope, intercept


def score_toxicity(docs: DataFrame, fitted: tuple[Index, float, float], text: str = "text", ident: str = "doc_id", k: int = NEIGHBOURS) -> DataFrame:
    """``id``, ``score``, and as evidence the identifiers and cosines of the nearest examples of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, slope, intercept = shared.value
        for batch in batches:
            scores, ids, likeness = [], [], []
            for t in texts_of(batch.column(1)):
                near, cosine = index.nearest(*index.vector(t), k)
                vote = index.vote(near, cosine) if len(near) else 0.0
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, slope * vote + intercept)))))
                toxic = index.labels[near] == 1
                ids.append(index.ids[near[toxic]][:3].tolist())
                likeness.append(cosine[toxic][:3].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(batch.column(0).type)), pa.array(likeness, pa.list_(pa.float64()))],
                ["id", "score", "evidence_ids", "evidence_cosines"],
            )

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    schema = StructType().add("id", kind).add("score", "double").add("evidence_ids", ArrayType(kind)).add("evidence_cosines", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema)


def training_labels(labels: DataFrame, held: int = 0, folds: int = 5, ident: str = "doc_id") -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.filter(held_fold(F.col(ident), folds) != held)
