"""Leave-one-subject-out models against fits made one by one."""

import numpy as np
import pandas as pd
import pytest

from oscilla.operators import folds


def sample(subjects, rows, classes, seed):
    rng = np.random.default_rng(seed)
    n = subjects * rows
    pdf = pd.DataFrame({"s": np.repeat([f"p{i}" for i in range(subjects)], rows), "a": rng.normal(5, 3, n), "b": rng.normal(size=n)})
    score = 0.5 * (pdf["a"] - 5) - pdf["b"] + rng.logistic(size=n)
    pdf["y"] = 10 * np.digitize(score, np.linspace(-1.5, 1.5, classes - 1))
    return pdf


def fit_alone(train, family, alpha=1.0):
    """Newton's method on the training rows only, with a line search; penalty and weights by hand."""
    mean, sd = train[["a", "b"]].mean().to_numpy(), train[["a", "b"]].std(ddof=0).to_numpy()
    x = (train[["a", "b"]].to_numpy() - mean) / sd
    labels, y = np.unique(train["y"], return_inverse=True)
    counts = np.bincount(y)
    w = (len(y) / counts / len(counts))[y]
    model = family(len(labels), 2)
    penalty = np.r_[np.full(model.first_slope, 1e-6), np.full(model.size - model.first_slope, alpha)]
    theta = model.start(counts / len(y))
    for _ in range(100):
        value, grad, hess = model.loss(theta, x, y, w)
        step = np.linalg.lstsq(hess + np.diag(penalty), -(grad + penalty * theta), rcond=1e-13)[0]
        value += 0.5 * penalty @ theta**2
        while model.loss(theta + step, x, y, w)[0] + 0.5 * penalty @ (theta + step) ** 2 > value + 1e-9:
            step /= 2
        theta = theta + step
    return lambda row: labels[model.predict(theta, (row - mean) / sd)]


def alone(pdf, family):
    out = []
    for s in sorted(pdf["s"].unique()):
        predict = fit_alone(pdf[pdf["s"] != s], family)
        out += [(s, i, predict(r)) for i, r in zip(pdf.loc[pdf["s"] == s, "i"], pdf.loc[pdf["s"] == s, ["a", "b"]].to_numpy())]
    return sorted(out)


@pytest.mark.parametrize("family", [folds.Softmax, folds.ProportionalOdds])
@pytest.mark.parametrize("exact_above", [0.0, 1.0])
def test_all_folds_equal_single_fits(spark, family, exact_above):
    pdf = sample(40, 6, 3, 1)
    pdf["i"] = range(len(pdf))
    out = folds.loso_newton(spark.createDataFrame(pdf), ["a", "b"], "y", "s", family, exact_above=exact_above, keep=["i"])
    assert sorted(tuple(r) for r in out.select("s", "i", "prediction").collect()) == alone(pdf, family)


@pytest.mark.parametrize("family", [folds.Softmax, folds.ProportionalOdds])
def test_derivatives(family):
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(50, 2)), rng.integers(0, 4, 50), rng.random(50)
    model = family(4, 2)
    theta = model.start(np.full(4, 0.25)) + np.r_[0.0, np.linspace(-0.1, 0.3, model.size - 1)]
    _, grad, hess = model.loss(theta, x, y, w)
    for i, e in enumerate(np.eye(model.size) * 1e-5):
        up, down = model.loss(theta + e, x, y, w), model.loss(theta - e, x, y, w)
        assert abs((up[0] - down[0]) / 2e-5 - grad[i]) < 1e-6
        assert np.abs((up[1] - down[1]) / 2e-5 - hess[i]).max() < 1e-6


def test_joint_thresholds_are_ordered_and_likeliest(spark):
    """Cut points and slopes against a search that only sees the likelihood."""
    pdf = sample(1, 300, 4, 5)
    x = (pdf[["a", "b"]] - pdf[["a", "b"]].mean()).to_numpy() / pdf[["a", "b"]].std(ddof=0).to_numpy()
    y = np.unique(pdf["y"], return_inverse=True)[1]
    model = folds.ProportionalOdds(4, 2)
    data = spark.createDataFrame(pd.DataFrame({"_s": "p", "_x": list(x), "_y": y}))
    training = folds.Training(np.bincount(y).astype(float), x.sum(axis=0), (x**2).sum(axis=0), 0.0, False)
    theta = folds._newton(data, model, model.start(np.bincount(y) / len(y)), [training], [None])[0]
    assert (np.diff(theta[:3]) > 0).all()

    def likelihood(t):
        upper = 1 / (1 + np.exp(-(np.r_[t[:3], np.inf][y] - x @ t[3:])))
        lower = 1 / (1 + np.exp(-(np.r_[-np.inf, t[:3]][y] - x @ t[3:])))
        return np.log(np.maximum(upper - lower, 1e-300)).sum()

    best, width = np.r_[-1.0, 0.0, 1.0, 0.0, 0.0], 1.0
    while width > 1e-7:
        moves = [best + width * sign * e for e in np.eye(5) for sign in (1, -1)]
        top = max(moves, key=likelihood)
        best, width = (top, width) if likelihood(top) > likelihood(best) else (best, width / 2)
    assert np.abs(best - theta).max() < 1e-3 and likelihood(theta) >= likelihood(best) - 1e-9


def test_large_subject_nulls_and_single_class(spark):
    pdf = sample(30, 4, 3, 7)
    pdf.loc[:39, "s"] = None
    pdf["i"] = range(len(pdf))
    pdf.loc[50, "a"] = None
    df = spark.createDataFrame(pdf)
    mixed = folds.loso_newton(df, ["a", "b"], "y", "s", exact_above=0.2, keep=["i"])
    full = folds.loso_newton(df, ["a", "b"], "y", "s", exact_above=0.0, keep=["i"])
    pick = lambda d: sorted((r["i"], r["prediction"]) for r in d.collect())
    assert pick(mixed) == pick(full) and len(pick(full)) == len(pdf) - 1
    one = df.filter("y = 0")
    assert {r["prediction"] for r in folds.loso_newton(one, ["a", "b"], "y", "s").collect()} == {0}
    assert folds.loso_newton(df.limit(0), ["a", "b"], "y", "s").collect() == []
