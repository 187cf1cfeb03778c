"""Weights, scaling and forests of the model queries."""

import numpy as np
import pandas as pd
import pytest

from oscilla.operators import learn


def test_class_weights_without_a_join(spark):
    rows = [(0, 2.0)] * 6 + [(1, 1.0)] * 3 + [(2, 0.5)] + [(None, 1.0)]
    out = learn.balanced_weights(spark.createDataFrame(rows, "y int, w double"), "y", "w")
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0]
    assert "Join" not in plan.split("scalar-subquery")[0]
    got = {r["y"]: r["_weight"] for r in out.collect()}
    assert got == pytest.approx({0: 10 / 3 / 6 * 2.0, 1: 10 / 3 / 3, 2: 10 / 3 * 0.5})


def test_scaler_uses_the_moments_of_the_training_rows(spark):
    train = pd.DataFrame({"a": [1.0, 2.0, 6.0], "b": [5.0, 5.0, 5.0]})
    scaled = learn._scaler(spark.createDataFrame(train), ["a", "b"])
    (r,) = scaled(spark.createDataFrame(pd.DataFrame({"a": [9.0], "b": [7.0]}))).collect()
    assert r["features"].toArray() == pytest.approx([6.0 / np.std([1, 2, 6], ddof=1), 0.0])
