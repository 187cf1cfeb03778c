"""Dimension reduction and subject-wise cross-validated models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.operators import forest, stats
from oscilla.operators.cohort import null_safe_join
from oscilla.operators.ordering import number_rows
from oscilla.session import durable, shared_folder


# principal components with varimax rotation


def varimax(loadings: np.ndarray, rounds: int = 20, tol: float = 1e-6) -> np.ndarray:
    """Orthogonal rotation that maximises the variance of the squared loadings."""
    p, k = loadings.shape
    turn, best = np.eye(k), 0.0
    for _ in range(rounds):
        rotated = loadings @ turn
        target = rotated**3 - rotated * (rotated**2).sum(axis=0) / p
        u, s, vt = np.linalg.svd(loadings.T @ target)
        turn, previous, best = u @ vt, best, s.sum()
        if abs(best - previous) < tol:
            break
    return loadings @ turn


def pca_varimax(
    df: DataFrame, features: Sequence[str], max_components: int = 12, min_eigenvalue: float = 1.0
) -> DataFrame:
    """Rotated loadings of the components with eigenvalue >= 1, one row per feature and component.

    Standardised PCA needs nothing but the correlation matrix, one aggregate row of p^2 numbers; the
    eigenproblem is solved on that row.  Component signs are fixed by their largest loading.
    """
    p = len(features)
    pairs = stats.correlation_matrix(df, features)
    position = F.create_map(*[F.lit(x) for i, f in enumerate(features) for x in (f, i)])
    row = pairs.groupBy().agg(
        F.collect_list(
            F.struct(position[F.col("x")].alias("i"), position[F.col("y")].alias("j"), "r")
        ).alias("m"),
        F.max("n").alias("n"),
    )

    def solve(cells: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for entries, n in zip(cells, counts, strict=True):
            if n < 5 or p < 2:
                out.append([])
                continue
            corr = np.eye(p)
            for e in entries:
                corr[e["i"], e["j"]] = corr[e["j"], e["i"]] = e["r"]
            values, vectors = np.linalg.eigh(corr)
            values, vectors = values[::-1] * n / (n - 1), vectors[:, ::-1]
            limit = min(max_components, p, int(n) - 1)
            keep = min(max(1, int((values[:limit] >= min_eigenvalue).sum())), limit)
            rotated = varimax(vectors[:, :keep])
            flip = np.sign(rotated[np.abs(rotated).argmax(axis=0), np.arange(keep)])
            share = values / values.sum()
            out.append(
                [
                    {
                        "feature": features[i],
                        "component": f"PC{c + 1}",
                        "loading": float(rotated[i, c] * flip[c]),
                        "variance_share": float(share[c]),
                    }
                    for i in range(p)
                    for c in range(keep)
                ]
            )
        return pd.Series(out)

    schema = "array<struct<feature:string,component:string,loading:double,variance_share:double>>"
    solved = F.pandas_udf(solve, schema)(F.col("m"), F.col("n"))
    return row.select(F.explode(solved).alias("l")).select("l.*")


def top_loadings(loadings: DataFrame, n: int = 4) -> DataFrame:
    """Strongest features per component."""
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.abs("loading")).alias("k"), "feature", "loading"))
    )
    return loadings.groupBy("component").agg(F.slice(ordered, 1, n).alias("t")).select(
        "component", F.posexplode("t").alias("rank", "t")
    ).select("component", "rank", "t.feature", "t.loading")


# exact leave-one-subject-out regression


def _sums(features: Sequence[str], y: str) -> list[Column]:
    names = [*features, y]
    return [
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.sum(c) for c in names]).alias("_s"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("_q"),
    ]


def loso_ridge(
    df: DataFrame, features: Sequence[str], y: str, subject: str, alpha: float = 1.0, min_train: int = 5
) -> DataFrame:
    """Predictions of a ridge fit on everyone else, exact for any number of subjects.

    The training moments of a fold are the totals minus those of its subject, so one aggregation
    serves all folds: each subject's row solves its own small system.  Features are standardised
    on the training rows.  Adds ``prediction``; folds with fewer than ``min_train`` rows go.
    """
    p = len(features)
    clean = df
    for c in (*features, y, subject):
        clean = clean.filter(F.col(c).isNotNull())
    # centring first keeps the sums of squares small, so the subtraction stays accurate
    centre = clean.agg(F.struct(*[F.avg(c).alias(c) for c in (*features, y)])).scalar()
    shifted = clean.withColumn("_m", centre)
    shifted = shifted.withColumns({f"_z_{c}": F.col(c) - F.col(f"_m.{c}") for c in (*features, y)})
    z = [f"_z_{c}" for c in features]
    per_subject = shifted.groupBy(subject).agg(*_sums(z, f"_z_{y}"))
    total = shifted.agg(*_sums(z, f"_z_{y}")).select(F.struct("_n", "_s", "_q")).scalar()

    def solve(
        n: pd.Series, s: pd.Series, q: pd.Series, tn: pd.Series, ts: pd.Series, tq: pd.Series
    ) -> pd.Series:
        out = []
        for n0, s0, q0, n1, s1, q1 in zip(n, s, q, tn, ts, tq, strict=True):
            m = n1 - n0
            if m < min_train:
                out.append(None)
                continue
            mean = (np.asarray(s1) - np.asarray(s0)) / m
            cov = (np.asarray(q1) - np.asarray(q0)).reshape(p + 1, p + 1) / m - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0.0))
            sd[sd == 0] = 1.0
            gram = m * cov[:p, :p] / np.outer(sd, sd) + alpha * np.eye(p)
            beta = np.linalg.solve(gram, m * cov[:p, p] / sd) / sd
            out.append([float(mean[p] - beta @ mean[:p]), *map(float, beta)])
        return pd.Series(out)

    coefficients = per_subject.withColumn("_t", total).select(
        subject,
        F.pandas_udf(solve, "array<double>")("_n", "_s", "_q", "_t._n", "_t._s", "_t._q").alias("_b"),
    )
    joined = shifted.join(coefficients.filter(F.col("_b").isNotNull()), subject)
    fitted = reduce(
        lambda acc, i: acc + F.get("_b", F.lit(i + 1)) * F.col(z[i]), range(p), F.get("_b", F.lit(0))
    )
    return joined.withColumn("prediction", fitted + F.col(f"_m.{y}")).drop("_m", "_b", *z, f"_z_{y}")


def loso_mean(df: DataFrame, y: str, subject: str, min_train: int = 5) -> DataFrame:
    """Baseline: the mean of everyone else."""
    clean = df.filter(F.col(y).isNotNull())
    per = clean.groupBy(subject).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"))
    total = clean.agg(F.struct(F.count(y).alias("n"), F.sum(y).alias("s"))).scalar()
    others = per.withColumn("_t", total).filter(F.col("_t.n") - F.col("_n") >= min_train)
    mean = (F.col("_t.s") - F.col("_s")) / (F.col("_t.n") - F.col("_n"))
    return clean.join(others.select(subject, mean.alias("prediction")), subject)


# MLlib models under subject-wise folds


def classifiers(seed: int = 42) -> dict[str, object]:
    return {
        "logistic_regression": LogisticRegression(maxIter=1000),
        "random_forest": RandomForestClassifier(numTrees=200, maxDepth=10, seed=seed),
        "boosted_trees": OneVsRest(classifier=GBTClassifier(maxIter=200, seed=seed)),
    }


def regressors(seed: int = 42) -> dict[str, object]:
    return {
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "random_forest": RandomForestRegressor(numTrees=300, maxDepth=10, seed=seed),
        "boosted_trees": GBTRegressor(maxIter=300, seed=seed),
    }


def assign_folds(df: DataFrame, subject: str, folds: int | None, seed: int = 42) -> DataFrame:
    """All rows of a subject share a fold; without ``folds`` every subject is a fold of its own.

    The distinct subjects are numbered in a seeded order and dealt in turn, so folds differ by one
    subject at most and none is empty while there are enough subjects.
    """
    subjects = df.select(subject).distinct().withColumn("_o", F.xxhash64(F.col(subject), F.lit(seed)))
    dealt = number_rows(subjects, [], ["_o", subject], "_i")
    fold = F.col("_i") if folds is None else F.col("_i") % folds
    return null_safe_join(df, dealt.select(subject, fold.cast("int").alias("fold")), [subject])


def _fold_numbers(data: DataFrame) -> list[int]:
    """The folds that have rows: one number per fold, not per row."""
    return sorted(r["fold"] for r in data.select("fold").distinct().collect())


def _gathered(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """Predictions of all folds; each is written when it is made, so no plan grows with the folds."""
    path = f"{shared_folder(spark)}/oscilla-folds-{uuid.uuid4().hex}"
    schema = None
    for part in parts:
        part.write.mode("append").parquet(path)
        schema = part.schema
    if schema is None:
        raise ValueError("no complete rows to learn from")
    return spark.read.schema(schema).parquet(path)


def _scaler(train: DataFrame, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds the vector ``features``, standardised by the moments of ``train``: one aggregate row of numbers.

    A feature that is constant in ``train`` becomes 0.
    """
    row = train.agg(F.struct(*[F.avg(c) for c in features]).alias("m"), F.struct(*[F.stddev_samp(c) for c in features]).alias("s")).first()
    names = {c: f"_z_{c}" for c in features}
    scaled = {
        names[c]: (F.col(c) - F.lit(mean or 0.0)) * F.lit(1.0 / spread if spread else 0.0)
        for c, mean, spread in zip(features, row["m"], row["s"], strict=True)
    }
    assembler = VectorAssembler(inputCols=list(scaled), outputCol="features", handleInvalid="skip")
    return lambda df: assembler.transform(df.withColumns(scaled)).drop(*scaled)


def balanced_weights(train: DataFrame, label: str, weight: str | None) -> DataFrame:
    """Add ``_weight``: every class counts the same, times the row's own weight.

    The weights of the classes are one row, so no row is shuffled for them.
    """
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_n"))))
    known = counts.filter(F.col(label).isNotNull())
    classes = known.agg(F.struct((F.sum("_n") / F.count(F.lit(1))).alias("mean"), entries.alias("n"))).scalar()
    own = F.col(weight) if weight else F.lit(1.0)
    weighed = train.filter(F.col(label).isNotNull()).withColumn("_c", classes)
    return weighed.withColumn("_weight", F.col("_c.mean") / F.element_at("_c.n", F.col(label)) * own).drop("_c")


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    subject: str,
    estimator,
    folds: int | None = 5,
    weight: str | None = None,
    keep: Sequence[str] = (),
    balanced: bool = True,
) -> DataFrame:
    """Out-of-fold predictions; features are standardised on the training folds only.

    ``folds=None`` leaves one subject out at a time.
    ``balanced`` weighs classes equally (turn it off for regressors).  The driver loops over folds,
    never over rows, and the input is materialised once for all of them.
    """
    columns = list(dict.fromkeys([subject, label, *features, *keep, *([weight] if weight else [])]))
    data = df.select(*columns).na.drop(subset=[label, *features])
    data = assign_folds(data, subject, folds).withColumn("label", F.col(label).cast("double"))
    if weight:
        usable = F.coalesce(F.when(~F.isnan(weight), F.col(weight)), F.lit(0.0))
        data = data.withColumn(weight, F.greatest(F.lit(0.0), usable))
    data = durable(data)
    weighted = (balanced or weight) and estimator.hasParam("weightCol")
    if weighted:
        estimator = estimator.copy({estimator.getParam("weightCol"): "_weight"})

    def predicted(fold: int) -> DataFrame:
        train, test = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        if weighted:
            train = (
                balanced_weights(train, label, weight)
                if balanced
                else train.withColumn("_weight", F.col(weight))
            )
        scaled = _scaler(train, features)
        return estimator.fit(scaled(train)).transform(scaled(test)).select(subject, label, *keep, "fold", "prediction")

    return _gathered(df.sparkSession, map(predicted, _fold_numbers(data)))


def tune(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    subject: str,
    candidates: Sequence[object],
    folds: int = 3,
    score: Callable[[DataFrame], float] | None = None,
) -> object:
    """Best of a parameter grid by out-of-fold balanced accuracy (one number per candidate)."""

    def balanced(pred: DataFrame) -> float:
        return stats.classification_metrics(pred, label, "prediction").first()["balanced_accuracy"]

    judge = score or balanced
    results = [judge(cross_validate(df, features, label, subject, c, folds)) for c in candidates]
    return candidates[int(np.argmax(results))]


def ordinal_cross_validate(
    df: DataFrame, features: Sequence[str], label: str, subject: str, classes: int, folds: int | None = 5
) -> DataFrame:
    """Ordinal model: one logistic model per threshold, predictions count the passed thresholds."""
    data = durable(assign_folds(df.select(subject, label, *features).na.drop(), subject, folds))

    def predicted(fold: int) -> DataFrame:
        train, test = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        scaled = _scaler(train, features)
        fit_on, scored = scaled(train), scaled(test)
        for k in range(classes - 1):
            model = LogisticRegression(maxIter=1000, probabilityCol=f"_p{k}", rawPredictionCol=f"_r{k}", predictionCol=f"_c{k}")
            binary = fit_on.withColumn("label", (F.col(label) > k).cast("double"))
            scored = model.fit(binary).transform(scored)
        passed = sum(
            (
                (vector_to_array(f"_p{k}")[1] > 0.5).cast("int")
                for k in range(classes - 1)
            ),
            F.lit(0),
        )
        return scored.select(subject, label, "fold", passed.cast("double").alias("prediction"))

    return _gathered(df.sparkSession, map(predicted, _fold_numbers(data)))


def feature_importance(
    df: DataFrame, features: Sequence[str], label: str, top: int = 20, seed: int = 42
) -> DataFrame:
    """Strongest features of a random forest (200 trees of depth 10) on the complete rows."""
    rows, classes = forest.binned(df, features, label)
    weights = forest.importances(rows, classes, trees=200, depth=10, seed=seed)
    rows = [(f, float(w)) for f, w in zip(features, weights, strict=True)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)
