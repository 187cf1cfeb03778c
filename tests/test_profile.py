"""Tests over few groups from one profile, against plain formulas, and how often they read their input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oscilla.operators import report_steps, reports, stats


def ranks(v):
    return pd.Series(v).rank().to_numpy()


def rows():
    rng = np.random.default_rng(4)
    out = [("b", g, float(rng.integers(0, 6)) + 1e9) for g in ["x"] * 9 + ["y"] * 14 + ["z"] * 5 + [None] * 3]
    out += [("a", "x", 4.0), ("a", "y", 1.0), ("a", "y", 2.0), ("a", "lone", 9.0), ("a", "z", None)]
    return out


def test_profile_against_formulas(spark):
    order = F.try_element_at(F.create_map(*[F.lit(x) for p in {"x": 2, "y": 1, "z": 1}.items() for x in p]), F.col("g"))
    df = spark.createDataFrame(rows(), "feature string, g string, v double").repartition(5)
    found = stats.profile(df, ["feature"], "g", "v", order)
    got = {(r["feature"], r["g"]): r for r in found.collect()}
    pdf = pd.DataFrame(rows(), columns=["feature", "g", "v"]).dropna()
    assert set(got) == {(f, g) for f, g in zip(pdf.feature, pdf.g, strict=True)}
    for (f, g), part in pdf.groupby(["feature", "g"]):
        r = got[f, g]
        assert (r["n"], r["min"], r["max"], r["med"]) == (len(part), part.v.min(), part.v.max(), part.v.median())
        assert r["mean"] == pytest.approx(part.v.mean(), rel=1e-15)
        assert (r["var"] is None) if len(part) == 1 else r["var"] == pytest.approx(part.v.var(), rel=1e-9)
    rho = {r["feature"]: r for r in stats.spearman_of(found, ["feature"], with_p=False).collect()}
    b = pdf[pdf.feature == "b"]
    want = np.corrcoef(ranks(b.g.map({"x": 2, "y": 1, "z": 1})), ranks(b.v))[0, 1]
    assert rho["b"]["rho"] == pytest.approx(want) and (rho["a"]["n"], rho["a"]["rho"]) == (3, None)
    h = {r["feature"]: r for r in stats.kruskal_of(found, ["feature"]).collect()}
    r, n = ranks(b.v), len(b)
    t = b.groupby("v").size().to_numpy().astype(float)
    raw = 12 / (n * (n + 1)) * sum(r[(b.g == g).to_numpy()].sum() ** 2 / (b.g == g).sum() for g in "xyz") - 3 * (n + 1)
    assert h["b"]["h"] == pytest.approx(raw / (1 - (t**3 - t).sum() / (n**3 - n)))
    assert (h["a"]["n_groups"], h["a"]["n"], h["a"]["h"]) == (1, 2, None)


def test_profile_without_keys(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "g int, v double")
    r = stats.kruskal(df, [], "g", "v").first()
    assert (r["n_groups"], r["n"]) == (3, 30) and stats.kruskal(df.limit(0), [], "g", "v").first()["h"] is None


@pytest.mark.parametrize("step", [lambda d: stats.alignment(d, "score", "value"), lambda d: report_steps.angle_tests(d, "angle")])
def test_input_is_read_once(spark, step):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    df = spark.range(200).select(
        F.lit("mean_amplitude").alias("feature"), (F.col("id") % 4).cast("int").alias("score"),
        F.element_at(F.array(*map(F.lit, ("front", "angled", "lateral"))), (F.col("id") % 3 + 1).cast("int")).alias("angle"),
        F.udf(counted, "double")((F.col("id") * 37 % 101).cast("double")).alias("v"),
    )
    assert step(df.withColumnRenamed("v", "value")).count() == 1
    # once for the values and once for the filter on them, where Spark pushes it below
    assert seen.value <= 400


def test_report_builds_only_what_is_asked_for(spark, monkeypatch):
    built = []
    for module, name in ((stats, "profile"), (stats, "posthoc"), (reports.steps, "summaries"), (reports.steps, "extreme_outliers")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: built.append(_n) or _f(*a, **k))
    df = spark.createDataFrame([(i % 4, float(i * 7 % 31), float(i % 5)) for i in range(60)], "score int, mean_amplitude double, other double")
    tables = reports.cohort_report(df, ["mean_amplitude", "other"])
    assert built == [] and len(tables) == 9 and "posthoc" in tables
    long = stats.long_features(df, ["score"], ["mean_amplitude", "other"])
    for name, alone in (("correlation", stats.spearman(long, ["feature"], "score", "value")), ("effects", stats.effect_sizes(long, ["feature"], "score", "value"))):
        got, want = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str) for d in (tables[name], alone))
        assert got == want
    assert tables["omnibus"].count() == 2 and tables["directions"].count() == 2
    assert built == ["profile"] and tables["omnibus"] is tables["omnibus"]
