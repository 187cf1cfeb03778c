"""The forest from histograms: splits against brute force, partitions, cases, and MLlib's importances."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from oscilla.operators import forest, learn


def _table(n: int = 3_000) -> pd.DataFrame:
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4))
    y = np.digitize(2 * x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=n), [-1.5, 1.0])
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": rng.integers(0, 3, n).astype(float), "y": y})


def test_best_split_is_that_of_all_splits():
    rng = np.random.default_rng(3)
    rows = [(int(f), int(g), int(c)) for f, g, c in zip(rng.integers(0, 6, 80), rng.integers(0, 6, 80), rng.integers(0, 3, 80), strict=True)]
    counts = np.zeros((2, 1, 6, 3))
    for f, g, c in rows:
        counts[0, 0, f, c] += 1
        counts[1, 0, g, c] += 1

    def impurity(part):
        return 1 - sum((sum(r[2] == c for r in part) / len(part)) ** 2 for c in range(3)) if part else 0.0

    def gain(j, cut):
        left, right = [r for r in rows if r[j] <= cut], [r for r in rows if r[j] > cut]
        return impurity(rows) - (len(left) * impurity(left) + len(right) * impurity(right)) / len(rows)

    best = max(gain(j, cut) for j in range(2) for cut in range(5))
    node, feature, cut, found, left, right = forest.best_splits(counts, np.array([[4, 7]]))
    assert node.tolist() == [0] and found[0] == pytest.approx(best)
    assert gain([4, 7].index(feature[0]), cut[0]) == pytest.approx(best)
    assert left.sum() + right.sum() == len(rows)


def test_bootstrap_weights_are_poisson():
    table = forest.poisson()
    w = forest.weights(np.arange(200_000), 1, 0, table)
    assert w.mean(axis=0) == pytest.approx(np.ones(4), abs=0.02)
    assert w.astype(float).var(axis=0) == pytest.approx(np.ones(4), abs=0.03)
    assert np.abs(np.corrcoef(w.T.astype(float)) - np.eye(4)).max() < 0.02


def test_forest_does_not_depend_on_partitions(spark, monkeypatch):
    rows, classes = forest.binned(spark.createDataFrame(_table(1_000)), list("abcd"), "y")
    one = forest.importances(rows.coalesce(1), classes, trees=5, depth=7)
    monkeypatch.setattr(forest, "HELD", 100)
    several = forest.importances(rows.repartition(5), classes, trees=5, depth=7)
    assert np.array_equal(one, several)


def test_importances_agree_with_mllib(spark):
    df = spark.createDataFrame(_table())
    rows, classes = forest.binned(df, list("abcd"), "y")
    own = forest.importances(rows, classes, trees=40, depth=5)
    data = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    model = RandomForestClassifier(labelCol="y", numTrees=40, maxDepth=5, seed=1).fit(data)
    assert own == pytest.approx(model.featureImportances.toArray(), abs=0.05)
    assert own.sum() == pytest.approx(1.0)


def test_incomplete_rows_and_constant_features(spark):
    data = pd.DataFrame({"a": [0.0, 1.0, 0.0, 1.0, None, np.nan], "b": [2.0] * 6, "y": [0, 1, 0, 1, 1, None]})
    out = learn.feature_importance(spark.createDataFrame(data), ["a", "b"], "y").collect()
    assert [(r["feature"], r["importance"]) for r in out] == [("a", 1.0), ("b", 0.0)]
