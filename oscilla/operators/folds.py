"""Leave-one-subject-out for models fitted by Newton steps: all folds together, not one fit after another.

The model of all rows is fitted first, one pass over the rows per step.  Around it the loss is known by its
gradient, Hessian and third derivative, small tables of sums that do not grow with the rows.  The loss of a
fold is the whole one minus that of its own subject, so one more pass, in which each subject's rows are
summed up, gives the model of every fold.  The error of such a fold is of third order in the share
that its subject has in the rows.

Subjects with a larger share than ``exact_above`` (there are at most 1 / ``exact_above`` of them) get full Newton
steps over all rows, a block of folds per pass.  With ``exact_above=0`` every fold is fitted so.

Rows with a null in a feature or in the label take no part.  Rows without a subject are one fold.  A fold whose training
rows lack a class keeps that class' parameters near those of the least penalty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import combinations_with_replacement, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.session import durable, shuffle_slices

BLOCK_NUMBERS = 1_000_000
JITTER = 1e-6
TOLERANCE = 1e-9
GAIN = 1e-14
STEPS = 60
PIECE = 2_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _cubes(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over the rows of q x_i x_j x_m."""
    f = x.shape[1]
    out = np.empty((f, f, f))
    for i in range(f):
        out[i] = x.T @ (x * (q * x[:, i])[:, None])
    return out


@dataclass(frozen=True)
class Softmax:
    """Multinomial logistic model; parameters are the intercepts, then the slopes, by class."""

    classes: int
    features: int

    @property
    def size(self) -> int:
        return self.classes * (self.features + 1)

    @property
    def first_slope(self) -> int:
        return self.classes

    def start(self, shares: np.ndarray) -> np.ndarray:
        return np.concatenate([np.log(shares), np.zeros(self.classes * self.features)])

    def scales(self, variance: np.ndarray) -> np.ndarray:
        """Variance of the feature of each slope."""
        return np.tile(variance, self.classes)

    def _logits(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return theta[: self.classes] + x @ theta[self.classes :].reshape(self.classes, -1).T

    def loss(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = self._logits(theta, x)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1)
        value = float(w @ (np.log(total) - z[np.arange(len(y)), y]))
        p /= total[:, None]
        off = p.copy()
        off[np.arange(len(y)), y] -= 1.0
        off *= w[:, None]
        grad = np.concatenate([off.sum(axis=0), (off.T @ x).ravel()])
        k, f = self.classes, self.features
        wide = np.column_stack([np.ones(len(y)), x])
        hess = np.zeros((self.size, self.size))
        place = [np.r_[c, k + c * f : k + (c + 1) * f] for c in range(k)]
        for a in range(k):
            for b in range(a, k):
                cell = wide.T @ (wide * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
                hess[np.ix_(place[a], place[b])] = cell
                hess[np.ix_(place[b], place[a])] = cell.T
        return value, grad, hess

    def third(self, theta: np.ndarray, x: np.ndarray, label: int) -> np.ndarray:
        """Third derivatives of the unweighted loss of rows of one class; softmax has the same for all of them."""
        z = self._logits(theta, x)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        k, wide = self.classes, np.column_stack([np.ones(len(x)), x])
        slots = np.column_stack([np.arange(k), k + np.arange(k * self.features).reshape(k, -1)])
        out = np.zeros((self.size,) * 3)
        for a, b, c in combinations_with_replacement(range(k), 3):
            q = p[:, a] * p[:, b] * p[:, c] * 2.0
            q += (a == b == c) * p[:, a] - (a == b) * p[:, a] * p[:, c] - (a == c) * p[:, a] * p[:, b] - (b == c) * p[:, b] * p[:, a]
            cell = _cubes(wide, q)
            for i, j, m in set(permutations((a, b, c))):
                out[np.ix_(slots[i], slots[j], slots[m])] = cell
        return out

    def rows(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of each row."""
        z = self._logits(theta, x)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        n, k = p.shape
        off = p - (y[:, None] == np.arange(k))
        wide = np.column_stack([np.ones(n), x])
        order = np.concatenate([np.arange(k) * (self.features + 1), (np.arange(k)[:, None] * (self.features + 1) + 1 + np.arange(self.features)).ravel()])
        bend = p[:, :, None] * (np.eye(k) - p[:, None, :])
        grad = (off[:, :, None] * wide[:, None, :]).reshape(n, -1)[:, order]
        squares = wide[:, :, None] * wide[:, None, :]
        hess = (bend[:, :, None, :, None] * squares[:, None, :, None, :]).reshape(n, self.size, self.size)
        return grad, hess[:, order][:, :, order]

    def predict(self, theta: np.ndarray, x: np.ndarray) -> int:
        return int(np.argmax(self._logits(theta, x[None, :])[0]))

    def predict_all(self, thetas: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The same, row by row at its own parameters."""
        slopes = thetas[:, self.classes :].reshape(len(x), self.classes, -1)
        return (thetas[:, : self.classes] + np.einsum("nkf,nf->nk", slopes, x)).argmax(axis=1)


@dataclass(frozen=True)
class ProportionalOdds:
    """Cumulative logistic model with ordered cut points and one set of slopes, fitted jointly."""

    classes: int
    features: int

    @property
    def size(self) -> int:
        return self.classes - 1 + self.features

    @property
    def first_slope(self) -> int:
        return self.classes - 1

    def start(self, shares: np.ndarray) -> np.ndarray:
        below = np.cumsum(shares)[:-1]
        return np.concatenate([np.log(below / (1.0 - below)), np.zeros(self.features)])

    def scales(self, variance: np.ndarray) -> np.ndarray:
        return variance

    def loss(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cuts = self.classes - 1
        edges = np.concatenate([[-np.inf], theta[:cuts], [np.inf]])
        present = np.unique(y)
        if len(y) and (edges[present + 1] <= edges[present]).any():
            return math.inf, np.zeros(self.size), np.zeros((self.size, self.size))
        score = x @ theta[cuts:]
        upper, lower = edges[y + 1] - score, edges[y] - score
        ratio = np.zeros(len(y))
        inner = (y > 0) & (y < cuts)
        width = (edges[y + 1] - edges[y])[inner]
        ratio[inner] = 1.0 / np.expm1(width)
        value = np.logaddexp(0.0, -upper) + np.logaddexp(0.0, lower)
        value[inner] -= np.log(-np.expm1(-width))
        su, sl = _sigmoid(upper), _sigmoid(lower)
        bend = ratio * (1.0 + ratio)
        gu, gl = w * (su - 1.0 - ratio), w * (sl + ratio)
        huu, hll, hul = w * (su * (1.0 - su) + bend), w * (sl * (1.0 - sl) + bend), -w * bend
        slots = np.arange(cuts)
        ju = np.column_stack([(y[:, None] == slots).astype(float), -x * (y < cuts)[:, None]])
        jl = np.column_stack([(y[:, None] - 1 == slots).astype(float), -x * (y > 0)[:, None]])
        cross = ju.T @ (jl * hul[:, None])
        hess = ju.T @ (ju * huu[:, None]) + jl.T @ (jl * hll[:, None]) + cross + cross.T
        return float(w @ value), ju.T @ gu + jl.T @ gl, hess

    def _bends(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        cuts = self.classes - 1
        edges = np.concatenate([[-np.inf], theta[:cuts], [np.inf]])
        score = x @ theta[cuts:]
        su, sl = _sigmoid(edges[y + 1] - score), _sigmoid(edges[y] - score)
        ratio = np.zeros(len(y))
        inner = (y > 0) & (y < cuts)
        ratio[inner] = 1.0 / np.expm1((edges[y + 1] - edges[y])[inner])
        return su, sl, ratio

    def third(self, theta: np.ndarray, x: np.ndarray, label: int) -> np.ndarray:
        """Third derivatives of the unweighted loss of rows of one class."""
        cuts, y = self.classes - 1, np.full(len(x), label)
        su, sl, ratio = self._bends(theta, x, y)
        # the width of the class enters through ratio (1 + ratio), whose slope is -ratio (1 + ratio) (1 + 2 ratio)
        bend = ratio * (1.0 + ratio) * (1.0 + 2.0 * ratio)
        upper, lower = su * (1.0 - su) * (1.0 - 2.0 * su), sl * (1.0 - sl) * (1.0 - 2.0 * sl)
        wide = np.column_stack([np.ones(len(x)), -x])
        edge = {"u": label if label < cuts else None, "l": label - 1 if label > 0 else None}
        parts = {"uuu": upper - bend, "uul": bend, "ull": -bend, "lll": lower + bend}
        out = np.zeros((self.size,) * 3)
        slopes = np.arange(cuts, self.size)
        for kinds, q in parts.items():
            cell = _cubes(wide, q)
            for order in set(permutations(kinds)):
                if any(edge[e] is None for e in order):
                    continue
                place = [np.r_[edge[e], slopes] for e in order]
                out[np.ix_(*place)] += cell
        return out

    def rows(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of each row."""
        cuts = self.classes - 1
        su, sl, ratio = self._bends(theta, x, y)
        bend, slots = ratio * (1.0 + ratio), np.arange(cuts)
        ju = np.column_stack([(y[:, None] == slots).astype(float), -x * (y < cuts)[:, None]])
        jl = np.column_stack([(y[:, None] - 1 == slots).astype(float), -x * (y > 0)[:, None]])
        grad = ju * (su - 1.0 - ratio)[:, None] + jl * (sl + ratio)[:, None]

        def outer(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (a * q[:, None])[:, :, None] * b[:, None, :]

        cross = outer(ju, jl, -bend)
        return grad, outer(ju, ju, su * (1.0 - su) + bend) + outer(jl, jl, sl * (1.0 - sl) + bend) + cross + cross.transpose(0, 2, 1)

    def predict_all(self, thetas: np.ndarray, x: np.ndarray) -> np.ndarray:
        """As ``predict``, row by row at its own parameters."""
        cuts = self.classes - 1
        score = np.einsum("nf,nf->n", thetas[:, cuts:], x)
        return (np.maximum.accumulate(thetas[:, :cuts], axis=1) < score[:, None]).sum(axis=1)

    def predict(self, theta: np.ndarray, x: np.ndarray) -> int:
        cuts = self.classes - 1
        return int((np.maximum.accumulate(theta[:cuts]) < x @ theta[cuts:]).sum())


Family = Softmax | ProportionalOdds


@dataclass(frozen=True)
class Training:
    """What a fold trains on: class counts, sums and sums of squares of the features, the penalty."""

    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    alpha: float
    balanced: bool

    def without(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Training:
        return replace(self, counts=self.counts - counts, sums=self.sums - sums, squares=self.squares - squares)

    def weights(self) -> np.ndarray:
        """Weight of a row by class: all classes present count the same where balanced."""
        some = self.counts > 0
        if not self.balanced:
            return some.astype(float)
        return np.where(some, self.counts.sum() / np.maximum(self.counts, 1.0) / max(some.sum(), 1), 0.0)

    def penalty(self, family: Family) -> np.ndarray:
        """Quadratic penalty by parameter: slopes of standardised features; next to none on the rest."""
        n = max(self.counts.sum(), 1.0)
        variance = np.maximum(self.squares / n - (self.sums / n) ** 2, 0.0)
        return np.concatenate([np.full(family.first_slope, JITTER), self.alpha * family.scales(variance) + JITTER])


def _step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(hess, -grad, rcond=1e-13)[0]


def _parts(pdf: pd.DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate(pdf["_x"].to_numpy()).reshape(-1, features) if len(pdf) else np.zeros((0, features))
    return x.astype(float), pdf["_y"].to_numpy(dtype=int)


def _evaluate(
    data: DataFrame, family: Family, thetas: np.ndarray, weights: np.ndarray, left_out: Sequence[str | None]
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian of a block of folds, each at its own parameters, in one pass over the rows.

    A partition sends one row of sums per fold, so what is shuffled and what reaches the driver has a fixed size.
    """
    d = family.size

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(thetas), 1 + d + d * d))
        for pdf in batches:
            x, y = _parts(pdf, family.features)
            own = pdf["_s"].to_numpy()
            for i, (theta, weight, subject) in enumerate(zip(thetas, weights, left_out, strict=True)):
                value, grad, hess = family.loss(theta, x, y, weight[y] * (own != subject))
                sums[i] += np.concatenate([[value], grad, hess.ravel()])
        yield pd.DataFrame({"fold": np.arange(len(thetas)), "v": list(sums)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "v": [np.stack(pdf["v"].to_numpy()).sum(axis=0)]})

    schema = "fold long, v array<double>"
    found = data.select("_s", "_x", "_y").mapInPandas(partial, schema).groupBy("fold").applyInPandas(total, schema).collect()
    rows = {r["fold"]: np.asarray(r["v"]) for r in found}
    empty = np.zeros(1 + d + d * d)
    blocks = [rows.get(i, empty) for i in range(len(thetas))]
    return [(float(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for v in blocks]


def _newton(data: DataFrame, family: Family, start: np.ndarray, training: Sequence[Training], left_out: Sequence[str | None]) -> np.ndarray:
    """Damped Newton steps for a block of folds; a step that doesn't lower the loss is halved.

    Folds that have converged leave the passes.
    """
    n = len(training)
    weights = np.stack([t.weights() for t in training])
    penalty = np.stack([t.penalty(family) for t in training])
    best, loss = np.tile(start, (n, 1)), np.full(n, math.inf)
    trial, step = best.copy(), np.zeros_like(best)
    live = list(range(n))
    for _ in range(STEPS):
        measured = _evaluate(data, family, trial[live], weights[live], [left_out[i] for i in live])
        still = []
        for i, (value, grad, hess) in zip(live, measured, strict=True):
            value += 0.5 * float(penalty[i] @ trial[i] ** 2)
            if not value <= loss[i] + 1e-12 * abs(loss[i]):
                step[i] /= 2.0
                if np.abs(step[i]).max() > TOLERANCE:
                    still.append(i)
            else:
                best[i], loss[i] = trial[i], value
                slope = grad + penalty[i] * trial[i]
                step[i] = _step(slope, hess + np.diag(penalty[i]))
                # in directions that the rows don't see a step is rounding and never shrinks: what it gains decides
                gains = -float(slope @ step[i]) > GAIN * abs(value)
                if gains and np.abs(step[i]).max() > TOLERANCE * (1.0 + np.abs(best[i]).max()):
                    still.append(i)
                else:
                    best[i] = best[i] + step[i]
            trial[i] = best[i] + step[i]
        live = still
        if not live:
            break
    return best


def _third(data: DataFrame, family: Family, theta: np.ndarray) -> np.ndarray:
    """Third derivatives by class, in closed form: one pass over the rows, a partition sends one row of sums per class."""
    d = family.size

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((family.classes, d, d, d))
        for pdf in batches:
            x, y = _parts(pdf, family.features)
            for c in np.unique(y):
                sums[c] += family.third(theta, x[y == c], int(c))
        yield pd.DataFrame({"c": np.arange(family.classes), "v": [v.ravel() for v in sums]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": pdf["c"].iloc[:1], "v": [np.sum(pdf["v"].to_list(), axis=0)]})

    found = data.select("_x", "_y").mapInPandas(partial, "c long, v array<double>").groupBy("c").applyInPandas(total, "c long, v array<double>")
    out = np.zeros((family.classes, d, d, d))
    for r in found.collect():
        out[r["c"]] = np.asarray(r["v"]).reshape(d, d, d)
    return out


def _expanded(theta: np.ndarray, training: Training, family: Family, grads: np.ndarray, hessians: np.ndarray, third: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Root of the fold's gradient, written out to second order around the model of all rows.

    ``grad`` and ``hess`` are the fold's own sums, weighted; the others are those of all rows by class.
    """
    w, penalty = training.weights(), training.penalty(family)
    g = np.tensordot(w, grads, 1) - grad + penalty * theta
    h = np.tensordot(w, hessians, 1) - hess + np.diag(penalty)
    t = np.tensordot(w, third, 1)
    delta = _step(g, h)
    for _ in range(8):
        bent = t @ delta
        move = _step(g + h @ delta + 0.5 * bent @ delta, h + bent)
        delta = delta + move
        # Newton's steps shrink by the square, so the next one is below the rounding
        if np.abs(move).max() <= 1e-9 * (np.abs(theta).max() + 1.0):
            break
    return theta + delta


def _expanded_all(theta: np.ndarray, training: Training, family: Family, grads: np.ndarray, hessians: np.ndarray, third: np.ndarray, sums: Sequence[list[np.ndarray]]) -> np.ndarray:
    """``_expanded`` for many subjects: steps by the Hessian of all rows, which differs from a fold's by the subject's share.

    Folds that don't settle so are solved one by one.
    """
    folds = [training.without(*s[:3]) for s in sums]
    w, penalty = np.stack([f.weights() for f in folds]), np.stack([f.penalty(family) for f in folds])
    own = np.stack([s[3] for s in sums]), np.stack([s[4] for s in sums])
    g = w @ grads - np.einsum("mk,mkd->md", w, own[0]) + penalty * theta
    h = np.tensordot(w, hessians, 1) - np.einsum("mk,mkde->mde", w, own[1])
    h[:, np.arange(family.size), np.arange(family.size)] += penalty
    k, d = family.classes, family.size
    cubes = third.reshape(k * d, d * d).T
    turn = np.linalg.pinv(np.tensordot(training.weights(), hessians, 1) + np.diag(training.penalty(family)), rcond=1e-13)
    delta, move = np.zeros_like(g), np.full_like(g, math.inf)
    enough = 1e-12 * (np.abs(theta).max() + 1.0)
    for _ in range(30):
        bent = ((delta[:, :, None] * delta[:, None, :]).reshape(-1, d * d) @ cubes).reshape(-1, k, d)
        move = -(g + np.einsum("mde,me->md", h, delta) + 0.5 * np.einsum("mk,mkd->md", w, bent)) @ turn
        delta = delta + move
        if not np.abs(move).max() > enough:
            break
    out = theta + delta
    for i in np.flatnonzero(~(np.abs(move).max(axis=1) <= enough)):
        weighted = w[i] @ own[0][i], np.tensordot(w[i], own[1][i], 1)
        out[i] = _expanded(theta, folds[i], family, grads, hessians, third, *weighted)
    return out


def loso_newton(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    subject: str,
    family: type[Softmax] | type[ProportionalOdds] = Softmax,
    alpha: float = 1.0,
    balanced: bool = True,
    exact_above: float = 0.01,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Predictions of a model fitted on everyone else: (subject, label, *keep, ``prediction``).

    ``alpha`` penalises the slopes of features standardised on the fold's training rows; ``balanced`` lets the
    classes of the training rows count the same.  ``prediction`` is a label of the input.
    """
    p = len(features)
    columns = list(dict.fromkeys([subject, label, *keep]))
    clean = df.na.drop(subset=[label, *features])
    empty = clean.select(*columns, F.col(label).alias("prediction")).limit(0)
    moments = clean.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(features)],
        F.array_sort(F.collect_set(label)).alias("labels"),
    ).first()
    labels = moments["labels"]
    k = len(labels)
    if k < 2:
        return clean.select(*columns, F.col(label).alias("prediction")) if k else empty
    vector = [(F.col(c) - F.lit(moments[f"m{i}"])) / F.lit(moments[f"d{i}"] or 1.0) for i, c in enumerate(features)]
    data = durable(
        clean.select(
            *columns,
            F.coalesce(F.concat(F.lit("s"), F.col(subject).cast("string")), F.lit("none")).alias("_s"),
            F.array(*vector).alias("_x"),
            (F.array_position(F.lit(labels), F.col(label)) - 1).cast("int").alias("_y"),
        )
    )
    model = family(k, p)
    summed = [F.sum(F.get("_x", F.lit(i))) for i in range(p)], [F.sum(F.get("_x", F.lit(i)) ** 2) for i in range(p)]
    sizes = [F.count_if(F.col("_y") == c) for c in range(k)]
    whole = data.agg(F.array(*sizes), F.array(*summed[0]), F.array(*summed[1])).first()
    training = Training(*[np.asarray(v, float) for v in whole], alpha, balanced)
    total = training.counts.sum()
    # at most 1 / exact_above subjects, unless every fold is asked to be fitted in full
    per_subject = data.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.array(*sizes), F.array(*summed[0]), F.array(*summed[1]))
    large = per_subject.filter(F.col("n") > exact_above * total).orderBy("_s").collect()
    theta = _newton(data, model, model.start(training.counts / total), [training], [None])[0]

    fitted: list[tuple[str, list[float]]] = []
    per = max(1, BLOCK_NUMBERS // (1 + model.size + model.size**2))
    for lo in range(0, len(large), per):
        block = large[lo : lo + per]
        alone = [training.without(*[np.asarray(v, float) for v in r[2:]]) for r in block]
        found = _newton(data, model, theta, alone, [r["_s"] for r in block])
        fitted += [(r["_s"], [float(v) for v in row]) for r, row in zip(block, found, strict=True)]
    names = {r["_s"] for r in large}
    exact = df.sparkSession.createDataFrame(fitted, "_s string, _theta array<double>")

    def predicted(rows: DataFrame) -> DataFrame:
        def score(parameters: pd.Series, vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="int32")
            x = np.concatenate(vectors.to_numpy()).reshape(len(vectors), p)
            return pd.Series(model.predict_all(np.concatenate(parameters.to_numpy()).reshape(len(x), -1), x))

        place = F.pandas_udf(score, "int")("_theta", "_x")
        return rows.select(*columns, F.get(F.lit(labels), place).alias("prediction"))

    of_large = predicted(data.join(F.broadcast(exact), "_s"))
    others = data.join(F.broadcast(exact.select("_s")), "_s", "left_anti")
    if sum(r["n"] for r in large) == total:
        return of_large
    grads, hessians = _class_sums(data, model, theta)
    third = _third(data, model, theta)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by subject: a piece of a batch and the sums of its subjects are held."""
        current, held = None, None
        for pdf in batches:
            for lo in range(0, len(pdf), PIECE):
                done = []
                part = pdf.iloc[lo : lo + PIECE]
                names = part["_s"].to_numpy()
                x, y = _parts(part, p)
                starts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1]
                sums = _subject_sums(model, theta, x, y, starts)
                for i, name in enumerate(names[starts]):
                    if name != current:
                        if held is not None:
                            done.append((current, held))
                        current, held = name, None
                    piece = [v[i] for v in sums]
                    held = piece if held is None else [a + b for a, b in zip(held, piece, strict=True)]
                if done:
                    yield finished(done)
        if held is not None:
            yield finished([(current, held)])

    def finished(done: list) -> pd.DataFrame:
        solved = _expanded_all(theta, training, model, grads, hessians, third, [s for _, s in done])
        return pd.DataFrame({"_s": pd.Series([n for n, _ in done], dtype=object), "_theta": pd.Series([list(t) for t in solved], dtype=object)})

    sorted_rows = others.select("_s", "_x", "_y").repartition(shuffle_slices(df.sparkSession), "_s").sortWithinPartitions("_s")
    thetas = durable(sorted_rows.mapInPandas(solve, "_s string, _theta array<double>"))
    rest = predicted(others.join(thetas, "_s"))
    return of_large.unionByName(rest) if names else rest


def _subject_sums(family: Family, theta: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Class counts, sums, sums of squares, gradients and Hessians by class of the stretches of rows that begin at ``starts``."""
    by_class = (y[:, None] == np.arange(family.classes)).astype(float)
    grad, hess = family.rows(theta, x, y)
    found = [np.add.reduceat(v, starts, axis=0) for v in (by_class, x, x**2)]
    for v in (grad, hess):
        shape = (-1,) + (1,) * (v.ndim - 1)
        found.append(np.stack([np.add.reduceat(v * by_class[:, c].reshape(shape), starts, axis=0) for c in range(family.classes)], axis=1))
    return found


def _class_sums(data: DataFrame, family: Family, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = family.classes
    found = _evaluate(data, family, np.tile(theta, (k, 1)), np.eye(k), [None] * k)
    return np.stack([f[1] for f in found]), np.stack([f[2] for f in found])
