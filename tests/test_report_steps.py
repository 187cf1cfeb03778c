"""Report steps against plain Python on small tables with gaps, ties and empty inputs."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.operators import cohort, reports
from oscilla.operators import report_steps as R

LOG = "video long, patient long, visit int, med string, hand string, record_type string, mean_amplitude double, peak_velocity double, mean_velocity double"
TOTAL = "patient long, visit int, med string, total string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_merge_totals(spark):
    logs = [
        (1, 1, 1, "On", "Left", "VIDEO", 10.0, 5.0, 1.0),
        (2, 1, 1, "On", "Left", "VIDEO", 20.0, 7.0, 3.0),
        (3, 1, 1, "On", "Right", "VIDEO", 30.0, None, 2.0),
        (4, 1, 1, "On", "Right", "ERROR", 99.0, 9.0, 9.0),
        (5, 2, 1, None, "Left", "VIDEO", 40.0, 6.0, 2.5),
        (6, 2, 2, "Off", "Left", "VIDEO", 50.0, 6.5, 2.5),
        (7, None, 1, "On", "Left", "VIDEO", 60.0, 8.0, 4.0),
    ]
    totals = [(1, 1, "On", "0"), (1, 1, "On", "0"), (2, 1, None, " 31 "), (2, 2, "Off", "12.5"), (None, 1, "On", "0"), (9, 1, "On", "3")]
    out = R.merge_totals(spark.createDataFrame(logs, LOG), spark.createDataFrame(totals, TOTAL), ["mean_amplitude", "peak_velocity", "mean_velocity"])
    got = {(r["patient"], r["med"], r["hand"]): r for r in rows_of(out)}
    assert set(got) == {(1, "On", "Left"), (1, "On", "Right"), (2, None, "Left"), (None, "On", "Left")}
    both = got[1, "On", "Left"]
    assert both["n_recordings"] == 2 and both["mean_amplitude"] == 15.0 and both["score"] == 0
    assert got[2, None, "Left"]["score"] == 31
    sd = statistics.stdev([15.0, 30.0, 60.0]), statistics.stdev([6.0, 8.0]), statistics.stdev([2.0, 2.0, 4.0])
    z = (40 - 35) / sd[0], (6 - 7) / sd[1], (2.5 - 8 / 3) / sd[2]
    assert got[2, None, "Left"]["composite_score"] == pytest.approx(-sum(z) / 3)
    empty = R.merge_totals(spark.createDataFrame(logs, LOG), spark.createDataFrame([], TOTAL), ["mean_amplitude"])
    assert empty.count() == 0


def long_table(spark, n=300):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        for f in ("a", "b", "c"):
            value = None if rng.random() < 0.1 else rng.gauss(0, 1) * (1 if f == "a" else 3) + (40 if f == "b" and i % 50 == 3 else 0)
            rows.append((f, rng.choice([0, 1, 2, None]), value if f != "c" else (5.0 if value is not None else None), rng.choice([None, 40.0, 55.0, 61.5]), rng.choice([1.0, 2.0])))
    return rows, spark.createDataFrame(rows, "feature string, score int, value double, age double, gender double")


def test_summaries(spark):
    rows, df = long_table(spark)
    got = {(r["feature"], r["score"]): r for r in rows_of(R.summaries(df, "score"))}
    groups = {}
    for f, s, v, *_ in rows:
        if v is not None:
            groups.setdefault((f, s), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        r = got[key]
        assert r["n"] == len(values) and r["median"] == pytest.approx(statistics.median(values))
        assert r["std"] == pytest.approx(statistics.stdev(values)) and r["min"] == min(values) and r["max"] == max(values)


def test_outliers_equal_the_single_column(spark):
    _, df = long_table(spark)
    many = R.extreme_outliers(df)
    assert many.count() == df.count()
    for f in ("a", "b", "c"):
        one = cohort.extreme_outliers(df.filter(F.col("feature") == f), "value")
        counts = [d.groupBy("has_extremes", "is_extreme").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v")) for d in (one, many.filter(F.col("feature") == f))]
        assert sorted(map(str, counts[0].collect())) == sorted(map(str, counts[1].collect()))
    assert {r["feature"]: r["has_extremes"] for r in many.select("feature", "has_extremes").distinct().collect()}["b"] is True


def test_adjusted_equals_the_single_column(spark):
    _, df = long_table(spark)
    many = {(r["feature"], r["value"], r["age"], r["gender"]): r["adjusted"] for r in rows_of(R.adjusted(df, "value", "age", "gender"))}
    for f in ("a", "b"):
        for r in rows_of(cohort.residualise(df.filter(F.col("feature") == f), "value", "age", "gender")):
            got = many[f, r["value"], r["age"], r["gender"]]
            assert got is None if r["adjusted"] is None else got == pytest.approx(r["adjusted"])


def test_adjusted_degenerate(spark):
    alike = [("same_age", 50.0, float(g), 3.0 * g + i % 2) for i in range(8) for g in (1, 2)]
    tied = [("tied", 40.0 + 10 * g, float(g), 2.0 * g + i % 3) for i in range(6) for g in (1, 2)]
    few = [("few", 40.0, 1.0, 7.0), ("few", None, 1.0, 8.0)]
    df = spark.createDataFrame(alike + tied + few, "feature string, age double, gender double, value double")
    got = rows_of(R.adjusted(df, "value", "age", "gender"))
    for f in ("same_age", "tied"):
        means = [np.mean([r["adjusted"] for r in got if r["feature"] == f and r["gender"] == g]) for g in (1, 2)]
        assert means[0] == pytest.approx(means[1])
    assert sorted(r["adjusted"] for r in got if r["feature"] == "few") == [7.0, 8.0]
    assert R.adjusted(df.limit(0), "value", "age", "gender").count() == 0


def test_angles(spark):
    rows = [("x", a, float(v)) for a, vs in (("front", (1, 2, 3)), ("angled", (2, 4, 6)), ("lateral", (5, 7, 9)), ("other", (8,)), (None, (100,))) for v in vs]
    r = rows_of(R.angle_tests(spark.createDataFrame(rows, "feature string, angle string, value double")))[0]
    # the single value of the last angle takes part in the correlation only
    assert (r["n_groups"], r["n"], r["rho_n"]) == (3, 9, 10)
    ranks = {"front": [1, 2.5, 4], "angled": [2.5, 5, 7], "lateral": [6, 8, 9]}
    h = (12 / 90 * sum(sum(v) ** 2 / 3 for v in ranks.values()) - 30) / (1 - 6 / 720)
    assert r["h"] == pytest.approx(h) and r["p"] == pytest.approx(math.exp(-h / 2))
    df = spark.createDataFrame([("front", 0), ("front", 0), ("front", 1), ("lateral", 2), (None, 1), ("lateral", None)], "angle string, score int")
    got = {(x["angle"], x["score"]): (x["n"], round(x["percent"], 4)) for x in rows_of(R.score_shares(df))}
    assert got == {("front", 0): (2, 66.6667), ("front", 1): (1, 33.3333), ("front", 2): (0, 0.0), ("lateral", 0): (0, 0.0), ("lateral", 1): (0, 0.0), ("lateral", 2): (1, 100.0)}


def test_factors(spark):
    rng = np.random.default_rng(2)
    x, y, q = rng.normal(size=30), rng.normal(size=30), rng.normal(size=30)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, q, strict=True)] + [(None, 1.0, 1.0), (1.0, float("nan"), 2.0), (float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fx double, ky double, q double")
    (r,) = rows_of(R.factor_correlations(df, ["fx"], ["ky"]))
    assert r["n"] == 30 and r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    (t,) = rows_of(R.factor_trends(df.filter("fx < 1e9 AND NOT isnan(ky)"), ["fx"], "q"))
    slope, intercept = np.polyfit(x, q, 1)
    assert t["n"] == 30 and t["slope"] == pytest.approx(slope) and t["intercept"] == pytest.approx(intercept)
    assert R.factor_correlations(df.limit(5), ["fx"], ["ky"]).count() == 0
    assert R.factor_trends(df.limit(4), ["fx"], "q").count() == 0


def test_cohort_report_has_all_steps(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        p, visit = i % 20, i // 20 % 3 + 1
        rows.append((i, p, visit, ("Off", "On")[i // 60 % 2], ("Left", "Right")[i // 120], i % 4, 40.0 + p, float(p % 2 + 1), ("front", "lateral")[p % 2], rng.random(), rng.random() * 9, float(rng.randrange(5, 30)), rng.random(), rng.random()))
    names = "video long, patient long, visit int, med string, hand string, score int, age double, gender_code double, recording_angle string, mean_amplitude double, amplitude_cv double, total_cycles double, sharpness double, signal_quality double"
    tables = reports.cohort_report(spark.createDataFrame(rows, names), ["mean_amplitude", "amplitude_cv", "absent"], ["sharpness", "luminance"])
    wanted = {"summary", "outliers", "cycle_counts", "adjusted", "longitudinal", "medication", "angles", "angle_scores", "factors", "factor_correlations", "factor_trends"}
    assert wanted <= set(tables)
    assert tables["adjusted"].count() == 480 and tables["outliers"].count() == 480
    assert {r["feature"] for r in tables["longitudinal"].collect()} == {"mean_amplitude", "amplitude_cv"}
    assert {r["feature"] for r in tables["medication"].collect()} == {"mean_amplitude", "amplitude_cv"}
    assert tables["angles"].count() == 2 and tables["factor_correlations"].count() == 2 and tables["cycle_counts"].count() == 1
