"""Closed forms of the fold models against differences and against sums made subject by subject."""

import numpy as np
import pytest

from oscilla.operators import folds


def model_of(family):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 2)), rng.integers(0, 4, 60)
    model = family(4, 2)
    return model, model.start(np.full(4, 0.25)) + np.r_[0.0, np.linspace(-0.1, 0.3, model.size - 1)], x, y


@pytest.mark.parametrize("family", [folds.Softmax, folds.ProportionalOdds])
def test_third_derivatives(family):
    model, theta, x, y = model_of(family)
    for c in range(4):
        part, own = x[y == c], y[y == c]
        found = model.third(theta, part, c)
        for i, e in enumerate(np.eye(model.size) * 1e-5):
            up, down = (model.loss(theta + s * e, part, own, np.ones(len(own)))[2] for s in (1, -1))
            assert np.abs((up - down) / 2e-5 - found[:, :, i]).max() < 1e-6


@pytest.mark.parametrize("family", [folds.Softmax, folds.ProportionalOdds])
def test_sums_of_stretches(family):
    model, theta, x, y = model_of(family)
    starts = np.array([0, 1, 20, 33])
    found = folds._subject_sums(model, theta, x, y, starts)
    for i, (lo, hi) in enumerate(zip(starts, [*starts[1:], 60], strict=True)):
        assert found[0][i].tolist() == np.bincount(y[lo:hi], minlength=4).tolist() and np.allclose(found[1][i], x[lo:hi].sum(axis=0))
        for c in range(4):
            pick = np.flatnonzero(y[lo:hi] == c) + lo
            _, grad, hess = model.loss(theta, x[pick], y[pick], np.ones(len(pick)))
            assert np.allclose(found[3][i, c], grad) and np.allclose(found[4][i, c], hess)


@pytest.mark.parametrize("family", [folds.Softmax, folds.ProportionalOdds])
def test_predictions_row_by_row(family):
    model, theta, x, _ = model_of(family)
    thetas = theta + np.random.default_rng(1).normal(size=(60, model.size))
    assert model.predict_all(thetas, x).tolist() == [model.predict(t, r) for t, r in zip(thetas, x, strict=True)]


def test_third_derivatives_take_one_pass(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(folds, "_evaluate", lambda *a, **k: calls.append(1))
    model, theta, x, y = model_of(folds.Softmax)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "_x array<double>, _y int")
    found = folds._third(df, model, theta)
    assert not calls and all(np.allclose(found[c], model.third(theta, x[y == c], c)) for c in range(4))


@pytest.mark.parametrize("family", [folds.Softmax, folds.ProportionalOdds])
def test_many_folds_at_once(family):
    rng = np.random.default_rng(8)
    x, n = rng.normal(size=(4000, 2)), 4000
    y = np.digitize(x[:, 0] + rng.logistic(size=n), [-1.0, 0.0, 1.0])
    model = family(4, 2)
    starts = np.r_[np.arange(0, 200, 5), 200]
    counts = np.bincount(y).astype(float)
    training = folds.Training(counts, x.sum(axis=0), (x**2).sum(axis=0), 1.0, True)
    theta = model.start(counts / n)
    for _ in range(30):
        _, grad, hess = model.loss(theta, x, y, training.weights()[y])
        theta = theta + folds._step(grad + training.penalty(model) * theta, hess + np.diag(training.penalty(model)))
    whole = folds._subject_sums(model, theta, x, y, np.array([0]))
    third = np.stack([model.third(theta, x[y == c], c) for c in range(4)])
    sums = [[v[i] for v in folds._subject_sums(model, theta, x, y, starts)] for i in range(len(starts) - 1)]
    found = folds._expanded_all(theta, training, model, whole[3][0], whole[4][0], third, sums)
    for i, s in enumerate(sums):
        w = training.without(*s[:3]).weights()
        alone = folds._expanded(theta, training.without(*s[:3]), model, whole[3][0], whole[4][0], third, w @ s[3], np.tensordot(w, s[4], 1))
        assert np.abs(found[i] - alone).max() < 1e-8
