"""Statistics against closed forms, tables and brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oscilla.functions import pvalues as P
from oscilla.operators import cohort, curation, jobs, learn, matching, paired, stats


def test_published_tail_values():
    assert P.chi2_sf(9.488, 4) == pytest.approx(0.05, abs=1e-4)
    assert P.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert P.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert P.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert P.f_sf(3.326, 5, 10) == pytest.approx(0.05, abs=1e-3)
    assert 2 * P.normal_sf(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert np.allclose(P.normal_quantile(np.array([0.025, 0.5, 0.975, 0.001])), [-1.959964, 0, 1.959964, -3.090232], atol=1e-6)


def test_exact_small_sample_tests():
    n = 7
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in (0, 3, 8):
        want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
        assert P.signed_rank_exact(w, n) == pytest.approx(want)
    n1, n2 = 3, 4
    us = []
    for pick in itertools.combinations(range(7), n1):
        us.append(sum(i > j for i in pick for j in set(range(7)) - set(pick)))
    for u in (7, 10, 12):
        assert P.mann_whitney_exact(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(x >= u for x in us) / len(us)))


def test_shapiro_on_published_sample(spark):
    # weights of eleven men, the worked example of the original 1965 paper: W = 0.79
    men = [float(v) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)]
    df = spark.createDataFrame([(v,) for v in men], "value double")
    row = stats.shapiro(df, [], "value").first()
    assert row["w"] == pytest.approx(0.79, abs=0.01) and row["p"] < 0.01
    normal = np.random.default_rng(0).normal(size=200).tolist()
    row = stats.shapiro(spark.createDataFrame([(v,) for v in normal], "value double"), [], "value").first()
    assert row["w"] > 0.98 and row["p"] > 0.05


@pytest.fixture(scope="module")
def cohort_df(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"score": rng.integers(0, 5, 300), "feature": "mean_amplitude"})
    pdf["value"] = np.round(60 - 4 * pdf["score"] + rng.normal(0, 8, 300), 1)
    return pdf, spark.createDataFrame(pdf)


def test_spearman_and_p(spark, cohort_df):
    pdf, df = cohort_df
    row = stats.spearman(df, ["feature"], "score", "value").first()
    want = pdf["score"].rank().corr(pdf["value"].rank())
    assert row["rho"] == pytest.approx(want) and 0 <= row["p"] < 0.05
    few = df.limit(4)
    assert stats.spearman(few, ["feature"], "score", "value").first()["rho"] is None


def test_mann_whitney_counts(spark, cohort_df):
    pdf, df = cohort_df
    got = {r["score"]: r["u"] for r in stats.mann_whitney_vs_lowest(df, ["feature"], "score", "value").collect()}
    ref = pdf.loc[pdf["score"] == 0, "value"].to_numpy()
    for s in (1, 4):
        x = pdf.loc[pdf["score"] == s, "value"].to_numpy()
        want = (ref[:, None] > x[None, :]).sum() + 0.5 * (ref[:, None] == x[None, :]).sum()
        assert got[s] == pytest.approx(want)


def test_posthoc_bonferroni(spark, cohort_df):
    rows = stats.posthoc(cohort_df[1], ["feature"], "score", "value").collect()
    assert len(rows) == 4
    for r in rows:
        assert r["p_bonferroni"] == pytest.approx(min(1.0, 4 * r["p_raw"]))
        assert r["test"] in ("t-test", "MWU")


def test_ancova_without_covariates_is_anova(spark, cohort_df):
    pdf, df = cohort_df
    groups = [g["value"].to_numpy() for _, g in pdf.groupby("score")]
    grand = pdf["value"].mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / 4
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (300 - 5)
    assert stats.ancova(df, ["feature"], "score", "value", []).first()["f"] == pytest.approx(between / within)


def test_wilcoxon_exact_branch(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.5, -0.5, 3.0, 4.2, 5.1)], "d double")
    row = stats.wilcoxon(df, [], "d").first()
    assert (row["w_plus"], row["w_minus"]) == (20.0, 1.0) and row["p"] == pytest.approx(0.0625)


def test_friedman_textbook(spark):
    rows = [(1.0, 2.0, 3.0)] * 5
    row = stats.friedman(spark.createDataFrame(rows, "a double, b double, c double"), [], ["a", "b", "c"]).first()
    assert row["chi2"] == pytest.approx(10.0) and row["p"] == pytest.approx(math.exp(-5))


def test_null_keys_match_in_merges(spark):
    left = spark.createDataFrame([(1, None, 5.0), (2, "On", 6.0)], "k int, med string, x double")
    right = spark.createDataFrame([(1, None, 9), (2, "Off", 8)], "k int, med string, s int")
    assert [tuple(r) for r in cohort.merge_scores(left, right, ["k", "med"]).collect()] == [(1, None, 5.0, 9)]


def test_composites_need_controls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0)], "score int, mean_amplitude double")
    assert cohort.composite_score(df).filter("composite_score is not null").count() == 0
    wide = spark.createDataFrame(
        [(0, 5.0, 1.0, 1.0), (0, 5.0, 2.0, 3.0)], "score int, mean_amplitude double, peak_velocity double, mean_velocity double"
    )
    assert cohort.composite_score(wide).filter("composite_score is not null").count() == 0
    assert cohort.composite_v2(wide).filter("clinical_composite_v2 is not null").count() == 0


def test_quality_filter_rejects_bad_thresholds(spark):
    df = spark.createDataFrame([("a", 1)], "video_path string, quality_label int")
    best = cohort.best_quality_labels(df, "video_path", "quality_label")
    with pytest.raises(ValueError):
        cohort.quality_filter(df, best, "video_path", 4)
    with pytest.raises(ValueError):
        cohort.best_quality_labels(df, "video_path", "absent")


def brute_match(det, man, tol):
    pairs = sorted((abs(d - m), i, j) for i, d in enumerate(det) for j, m in enumerate(man) if abs(d - m) <= tol)
    used_d, used_m, out = set(), set(), []
    for e, i, j in pairs:
        if i not in used_d and j not in used_m:
            used_d.add(i), used_m.add(j), out.append(e)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_matching_brute_force(seed):
    rng = np.random.default_rng(seed)
    det, man = np.sort(rng.uniform(0, 5, 15)), np.sort(rng.uniform(0, 5, 12))
    assert np.allclose(matching.match_times(det, man, 0.3), brute_match(det, man, 0.3))


def test_accuracy_rows(spark):
    df = spark.createDataFrame(
        [(1, [0.05, 1.05, 9.0], [0.0, 1.0, 2.0]), (2, [], [1.0]), (3, [1.0], [])],
        "video int, det array<double>, man array<double>",
    )
    rows = {r["video"]: r for r in matching.cycle_accuracy(df, ["video"], 0.16).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1]["tp"], rows[1]["fp"], rows[1]["fn"]) == (2, 1, 1) and rows[1]["mae_s"] == 0.05
    assert (rows[2]["tp"], rows[2]["f1"], rows[2]["mae_s"]) == (0, 0.0, None)


def test_set_distances_brute_force(spark):
    det, man = [0.0, 1.0, 5.0], [0.5, 4.0]
    rows = [(1, t, "det") for t in det] + [(1, t, "man") for t in man]
    r = matching.set_distances(spark.createDataFrame(rows, "video int, t double, side string"), ["video"]).first()
    d2m = [min(abs(a - b) for b in man) for a in det]
    m2d = [min(abs(a - b) for b in det) for a in man]
    assert r["nn_det_to_man"] == pytest.approx(np.mean(d2m)) and r["hausdorff"] == max(max(d2m), max(m2d))
    grid = np.linspace(0, 5, 500001)
    f = np.searchsorted(sorted(det), grid, "right") / 3 - np.searchsorted(sorted(man), grid, "right") / 2
    assert r["wasserstein"] == pytest.approx(np.abs(f).mean() * 5, abs=1e-3)


def test_budget_threshold_brute_force(spark):
    rng = np.random.default_rng(7)
    ple, frames = np.round(rng.random(120), 4), rng.integers(100, 400, 120)
    df = spark.createDataFrame([(i, float(p), int(f)) for i, (p, f) in enumerate(zip(ple, frames))], "id int, p double, f int")
    got = curation.selection_threshold(df, "p", "f", "id", 3000, 12000, 5).first()
    order = np.lexsort((np.arange(120), -ple))
    p, c = ple[order], np.cumsum(frames[order])
    g = np.abs(np.diff(p)) / np.maximum(np.diff(c), 1)
    steep = [i + 1 for i, v in enumerate(g) if v > 2 * np.median(g[g > 0]) and c[i + 1] >= 3000]
    k = steep[0] if steep else np.flatnonzero(c <= 12000)[-1]
    k = max(k, np.flatnonzero(c >= 3000)[0]) if c[k] < 3000 else k
    k = np.flatnonzero(c <= 12000)[-1] if c[k] > 12000 else k
    assert got["rank"] == max(k, 4) and got["score"] == pytest.approx(p[max(k, 4)])


def test_agreement_of_identical_logs_is_one(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "k int, amp double")
    assert curation.agreement(df, df, "k", ["amp"]).first()["icc"] == pytest.approx(1.0)


def test_split_keeps_videos_together(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("video"))
    split = curation.train_val_split(df, "video", 0.25, 1)
    per = split.groupBy("video").agg(F.countDistinct("split").alias("n"))
    assert per.filter("n > 1").count() == 0
    share = split.filter("split = 'val'").count() / 2000
    assert 0.1 < share < 0.4


def test_loso_ridge_equals_refitting(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"s": rng.integers(0, 6, 80), "a": rng.normal(5, 2, 80), "b": rng.normal(100, 30, 80)})
    pdf["y"] = 2 * pdf["a"] - 0.1 * pdf["b"] + rng.normal(size=80)
    out = learn.loso_ridge(spark.createDataFrame(pdf), ["a", "b"], "y", "s").toPandas()
    merged = pdf.merge(out, on=["s", "a", "b", "y"])
    for s in range(6):
        tr, te = pdf[pdf["s"] != s], merged[merged["s"] == s]
        mu, sd = tr[["a", "b"]].mean(), tr[["a", "b"]].std(ddof=0)
        x = ((tr[["a", "b"]] - mu) / sd).to_numpy()
        beta = np.linalg.solve(x.T @ x + np.eye(2), x.T @ (tr["y"] - tr["y"].mean()))
        want = ((te[["a", "b"]] - mu) / sd).to_numpy() @ beta + tr["y"].mean()
        assert np.allclose(te["prediction"], want)


def test_varimax_keeps_communalities():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 3)))[0]
    rotated = learn.varimax(q)
    assert np.allclose((rotated**2).sum(axis=1), (q**2).sum(axis=1))
    assert (rotated**4).sum() >= (q**4).sum() - 1e-9


def test_visit_slope_matches_polyfit(spark):
    rows = [(1, 1, 2.0), (1, 2, 5.0), (1, 3, 3.0), (2, 1, 2.0), (2, 3, 8.0), (3, 2, 1.0)]
    df = spark.createDataFrame(rows, "k int, visit int, x double")
    got = {r["k"]: r["slope"] for r in paired.visit_wide(df, ["k"], "visit", "x").collect()}
    assert got[1] == pytest.approx(np.polyfit([1, 2, 3], [2, 5, 3], 1)[0])
    assert got[2] == pytest.approx(3.0) and got[3] is None


def test_jobs(spark):
    log = spark.createDataFrame(
        [("a", "VIDEO", True, [0.5], [1.0]), ("b", "VIDEO", True, [None], [1.0]), ("c", "ERROR", True, [0.5], [1.0]), ("d", "VIDEO", False, None, None)],
        "task string, record_type string, found boolean, cm array<double>, cu array<double>",
    )
    tasks = spark.createDataFrame([(t,) for t in "abcde"], "task string")
    done = jobs.valid_payload(F.col("found"), F.col("cm"), F.col("cu"))
    assert sorted(r[0] for r in jobs.remaining(tasks, log, ["task"], done).collect()) == ["b", "c", "e"]
    assert sorted(r[0] for r in jobs.unlogged(tasks, log, "task").collect()) == ["e"]
    parts = [jobs.stripe(tasks, ["task"], 2, r).collect() for r in (0, 1)]
    assert sorted(r[0] for p in parts for r in p) == list("abcde")


def test_null_keys_are_a_key(spark):
    rows = [(k, float(i), float((i * 7) % 11), i % 3) for k in ("a", None) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, x double, y double, g int")
    rho = stats.spearman(df, ["k"], "x", "y").collect()
    assert len(rho) == 2 and rho[0]["rho"] == pytest.approx(rho[1]["rho"])
    h = stats.kruskal(df, ["k"], "g", "x").collect()
    assert len(h) == 2 and {r["n_groups"] for r in h} == {3}
    assert len(stats.kendall_on_medians(df, ["k"], "g", "x").collect()) == 2


def test_spearman_matrix_with_ties(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"a": rng.integers(0, 4, 200).astype(float), "b": rng.normal(size=200), "c": rng.integers(0, 30, 200).astype(float)})
    got = {(r["x"], r["y"]): r["r"] for r in stats.correlation_matrix(spark.createDataFrame(data), ["a", "b", "c"], ranks=True).collect()}
    want = data.rank().corr()
    assert len(got) == 6 and all(v == pytest.approx(want.loc[x, y]) for (x, y), v in got.items())


def test_every_subject_is_a_fold(spark):
    from oscilla.operators import learn

    df = spark.createDataFrame([(f"s{i % 100}", i) for i in range(300)], "subject string, v int")
    strict = learn.assign_folds(df, "subject", None)
    assert strict.select("subject", "fold").distinct().count() == strict.select("fold").distinct().count() == 100
    sizes = [r["n"] for r in learn.assign_folds(df, "subject", 7).groupBy("fold").agg(F.countDistinct("subject").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_exact_rank_sums_at_any_size():
    # all orders of small groups, a recursion over groups of middling size, and the known total
    for m in range(1, 5):
        for n in range(1, 6):
            us = [sum(sum(j < i for j in range(m + n) if j not in c) for i in c) for c in itertools.combinations(range(m + n), m)]
            assert [P.rank_sums_at_most(k, m, n) for k in range(-1, m * n + 1)] == [sum(u <= k for u in us) for k in range(-1, m * n + 1)]
    # q^k of the product (1 - q^(n+i)) / (1 - q^i) by plain polynomial steps
    m, n = 8, 60
    row = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        row = [c - (row[j - n - i] if j >= n + i else 0) for j, c in enumerate(row)]
        for j in range(i, len(row)):
            row[j] += row[j - i]
    sums = list(itertools.accumulate(row))
    assert [P.rank_sums_at_most(k, m, n) for k in range(m * n + 1)] == sums
    for n in (2_000, 10**9):
        assert P.rank_sums_at_most(8 * n, 8, n) == math.comb(8 + n, 8)
        half = P.rank_sums_at_most(4 * n, 8, n) + P.rank_sums_at_most(4 * n - 1, 8, n)
        assert half == math.comb(8 + n, 8)  # symmetric about the middle
    # published 5 % two-sided critical values of U: 8 against 8 is 13, 5 against 10 is 8, 8 against 20 is 41
    for n1, n2, u in ((8, 8, 13), (5, 10, 8), (8, 20, 41)):
        assert P.mann_whitney_exact(n1 * n2 - u, n1, n2) <= 0.05 < P.mann_whitney_exact(n1 * n2 - u - 1, n1, n2)
    z = (4 * 2000 - 5000 + 0.5) / math.sqrt(8 * 2000 * 2009 / 12)
    assert abs(P.mann_whitney_exact(16000 - 5000, 8, 2000) / (2 * P.normal_sf(z)) - 1) < 0.1


def test_steadiness_and_membership(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, [0.2, nan, 0.4]), (2, [0.5]), (3, [nan]), (4, [0.9])], "k long, s array<double>")
    b = spark.createDataFrame([(1, [0.6]), (2, [0.8, None, 0.6]), (3, []), (5, [0.1])], "k long, s array<double>")
    got = curation.steadiness(a, b, "k", "s").first()
    assert got["mean_conf_a"] == pytest.approx(0.4) and got["mean_conf_b"] == pytest.approx(0.65)
    assert got["improvement_pct"] == pytest.approx(62.5)
    assert tuple(curation.steadiness(a.limit(0), b, "k", "s").first()) == (0.0, 0.0, 0.0)
    x = spark.createDataFrame([(1, "u"), (1, "u"), (None, "u"), (2, None)], "k long, l string")
    y = spark.createDataFrame([(None, "u"), (2, "v")], "k long, l string")
    assert {tuple(r) for r in jobs.membership(x, y, ["k", "l"]).collect()} == {(1, "u", "first"), (None, "u", "both"), (2, None, "first"), (2, "v", "second")}
