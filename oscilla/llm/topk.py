"""Exact top-k inner-product search by columnar branch and bound.

Queries and candidates are cut into blocks of a bounded size, and each pair of blocks is one group.
In a group the candidates lie column by column.  Scores accumulate over blocks of columns, those with
most mass first.  What the columns left can add or take away is at most the product of the remaining
norms, so a candidate goes as soon as its upper bound falls below the k-th best lower bound, and the
survivors are compacted before the next block of columns.  Each group returns its k best for each
query, and the best of those are ranked.

Cases: a vector that is null, or holds a null or non-finite component, takes no part.  Shorter vectors
count as filled with zeros.  Ties go to the smaller identifier.  Rows that repeat an identifier are
candidates of their own, but no query meets a row of its own identifier.  Scores are exact while the
absolute sum of products stays below 2 ** 53; larger ones are computed in unlimited integers and must
fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.session import durable

QUERY_BLOCK, CANDIDATE_BLOCK, COLUMNS = 512, 8192, 8


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, columns: int = COLUMNS) -> pd.DataFrame:
    """The k best candidates of a block for each query of a block."""
    width = max(map(len, [*queries["v"], *rows["v"]]))
    q, c = _matrix(queries["v"], width), _matrix(rows["v"], width)
    qids, cids = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
    big = float(np.abs(q).sum(1).max()) * float(np.abs(c).max(initial=0))
    if big >= 2**53:
        exact = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=False)) for b in rows["v"]] for a in queries["v"]]
    order = np.argsort(-(np.square(c).sum(0) * np.square(q).sum(0)), kind="stable")
    q, c = q[:, order], np.ascontiguousarray(c[:, order].T)
    cuts = list(range(0, width, columns)) + [width]
    # norms of what is left after each block of columns
    q_left = np.sqrt(np.stack([np.square(q[:, b:]).sum(1) for b in cuts[1:]])) if width else np.zeros((1, len(q)))
    c_left = np.sqrt(np.stack([np.square(c[b:]).sum(0) for b in cuts[1:]])) if width else np.zeros((1, c.shape[1]))
    first = q[:, : cuts[1]] @ c[: cuts[1]] if width else np.zeros((len(q), len(cids)))
    out_q, out_c, out_s = [], [], []
    for i, qid in enumerate(qids.tolist()):
        alive = np.flatnonzero(cids != qid)
        if big >= 2**53:
            score = np.array([exact[i][j] for j in alive], dtype=object)
        else:
            score = first[i, alive]
            for step in range(1, len(cuts) - 1):
                rest = q_left[step - 1, i] * c_left[step - 1, alive] * (1 + 1e-9) + 1e-6
                if len(alive) > k:
                    low = score - rest
                    bar = np.partition(low, len(low) - k)[len(low) - k]
                    stay = score + rest >= bar
                    alive, score = alive[stay], score[stay]
                a, b = cuts[step], cuts[step + 1]
                score = score + q[i, a:b] @ c[a:b, alive]
        top = np.lexsort((cids[alive], -score if score.dtype != object else [-s for s in score]))[:k] if len(alive) else []
        out_q += [qid] * len(top)
        out_c += cids[alive][top].tolist() if len(top) else []
        out_s += [int(round(s)) if not isinstance(s, int) else s for s in (score[top].tolist() if len(top) else [])]
    return pd.DataFrame({"query_id": out_q, "vec_id": out_c, "score": out_s}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` from ``queries`` (``query_id``, ``v``) and ``candidates`` (``vec_id``, ``v``)."""
    nq, nc = queries.count(), candidates.count()
    qn, cn = max(1, -(-nq // query_block)), max(1, -(-nc // candidate_block))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", place("query_id", qn)).withColumn("cb", every(cn))
    right = candidates.withColumn("cb", place("vec_id", cn)).withColumn("qb", every(qn))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return best_of_block(a, b, k)

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """The k best other rows for each row whose identifier is divisible by ``every``.

    Of rows that repeat such an identifier the one with the least vector (by its scaled components, the
    first that differs decides) is the query.
    """
    rows = durable(vectors.select(F.col(ident).alias("vec_id"), scaled(F.col(vector), scale).alias("v")).filter("v IS NOT NULL AND vec_id IS NOT NULL"))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(asked.select(F.col("vec_id").alias("query_id"), "v"), rows, k)
