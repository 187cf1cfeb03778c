"""Steps of the cohort, angle and video-quality reports that look at many features at once.

Features are rows (``feature``, ``value``), so a step is one grouped aggregate whatever their number; what
is joined back is one row per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators import cohort, stats
from oscilla.operators.cohort import null_safe_join
from oscilla.operators.ordering import exact_percentiles
from oscilla.session import durable

TOTAL_KEYS = ["patient", "visit", "med"]
FEWEST_COMPLETE = 10  # fixed value: complete rows below which a correlation table is empty


def merge_totals(logs: DataFrame, totals: DataFrame, features: Sequence[str], total: str = "total") -> DataFrame:
    """Recordings with the total score of their visit, one row per condition, with the composite score.

    Totals have no hand, so both hands of a visit meet the same one.  Missing keys match missing keys;
    totals that are no whole number go.  Repeated totals of a visit multiply no recording: the
    least one counts.
    """
    one = totals.groupBy(*TOTAL_KEYS).agg(F.min(N.integer_score(F.col(total))).alias("score"))
    recordings = cohort.only_videos(logs)
    kept = recordings.select(*[c for c in recordings.columns if c != "score"])
    merged = null_safe_join(kept, one.filter(F.col("score").isNotNull()), TOTAL_KEYS)
    numeric = cohort.available(merged, [*features, "score"])
    other = cohort.available(merged, ["video_path", "recording_angle"])
    collapsed = cohort.collapse_same_condition(merged, [*TOTAL_KEYS, "hand"], numeric, other, "video")
    return cohort.composite_score(collapsed.withColumn("score", N.integer_score(F.col("score"))))


def summaries(long: DataFrame, group: str, value: str = "value") -> DataFrame:
    """count, mean, std (n-1), median, min and max per feature and group; a null group is one of them."""
    clean = durable(long.filter(F.col(value).isNotNull()).select("feature", group, value))
    base = clean.groupBy("feature", group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return null_safe_join(base, exact_percentiles(clean, ["feature", group], value, {"median": 0.5}), ["feature", group])


def extreme_outliers(long: DataFrame, value: str = "value", factor: float = 3.0) -> DataFrame:
    """``is_extreme`` per value and ``has_extremes`` per feature, as ``cohort.extreme_outliers`` for one column."""
    present = long.filter(F.col(value).isNotNull()).select("feature", value)
    fences = exact_percentiles(present, ["feature"], value, {"_q1": 0.25, "_q3": 0.75})
    fenced = null_safe_join(long, fences, ["feature"], "left")
    reach = factor * (F.col("_q3") - F.col("_q1"))
    outside = (F.col(value) < F.col("_q1") - reach) | (F.col(value) > F.col("_q3") + reach)
    flagged = durable(fenced.withColumn("is_extreme", F.coalesce(outside, F.lit(False))).drop("_q1", "_q3"))
    inner = F.when(~F.col("is_extreme"), F.col(value))
    within, whole = F.max(inner) - F.min(inner), F.max(value) - F.min(value)
    stretched = (F.count(value) >= 4) & (F.count_if("is_extreme") > 0) & (within > 0) & (whole > 2 * within)
    spans = flagged.groupBy("feature").agg(F.coalesce(stretched, F.lit(False)).alias("has_extremes"))
    return null_safe_join(flagged, spans, ["feature"])


def adjusted(long: DataFrame, value: str, age: str, gender: str) -> DataFrame:
    """``adjusted``: the residual on age and gender plus the mean, fitted for each feature on its complete rows.

    Features with fewer than five complete rows keep their values; incomplete rows get none.
    """
    complete = F.col(value).isNotNull() & F.col(age).isNotNull() & F.col(gender).isNotNull()
    female = F.when(F.col(gender) == 2, 1.0).otherwise(0.0)
    staged = long.withColumns(
        {"_y": F.when(complete, F.col(value).cast("double")), "_a": F.when(complete, F.col(age)), "_g": F.when(complete, female)}
    )
    pairs = {"aa": ("_a", "_a"), "gg": ("_g", "_g"), "ag": ("_a", "_g"), "ay": ("_a", "_y"), "gy": ("_g", "_y")}
    sums = staged.groupBy("feature").agg(
        F.count("_y").alias("_n"),
        F.avg("_a").alias("_ma"),
        F.avg("_g").alias("_mg"),
        *[F.covar_pop(*pair).alias(name) for name, pair in pairs.items()],
    )
    det = F.col("aa") * F.col("gg") - F.col("ag") * F.col("ag")
    solvable = F.abs(det) > 1e-12

    def slope(own: str, own_y: str, other: str, other_y: str) -> Column:
        # without two independent covariates the one that varies is fitted alone, age first
        joint = (F.col(own_y) * F.col(other) - F.col(other_y) * F.col("ag")) / F.nullif(det, F.lit(0.0))
        single = F.coalesce(F.col(own_y) / F.nullif(F.col(own), F.lit(0.0)), F.lit(0.0))
        return F.when(solvable, joint).otherwise(single if own == "aa" else F.when(F.col("aa") > 0, 0.0).otherwise(single))

    fit = sums.select(
        "feature", "_n", "_ma", "_mg", slope("aa", "ay", "gg", "gy").alias("_ba"), slope("gg", "gy", "aa", "ay").alias("_bg")
    )
    moved = F.col("_ba") * (F.col("_a") - F.col("_ma")) + F.col("_bg") * (F.col("_g") - F.col("_mg"))
    out = F.when(F.col("_n") < 5, F.col(value).cast("double")).otherwise(F.col("_y") - moved)
    joined = null_safe_join(staged, fit, ["feature"])
    return joined.withColumn("adjusted", out).select(*long.columns, "adjusted")


def cycle_count_check(df: DataFrame, cycles: str, variation: str) -> DataFrame:
    """Whether few cycles inflate the variation: a negative correlation beyond -0.15 with p below 0.05, from ten rows on."""
    out = stats.spearman(durable(df.select(cycles, variation)), [], cycles, variation)
    inflated = (F.col("n") >= 10) & (F.col("p") < 0.05) & (F.col("rho") < -0.15)
    return out.withColumn("inflated", F.coalesce(inflated, F.lit(False)))


# recording angles


def angle_tests(long: DataFrame, angle: str = "angle", value: str = "value") -> DataFrame:
    """Per feature: Kruskal-Wallis over the angles, and Spearman with the rank of the angle (``other`` last)."""
    ranks = F.create_map(*[F.lit(x) for pair in N.ANGLE_ORDINALS.items() for x in pair])
    profiled = stats.profile(long, ["feature"], angle, value, F.try_element_at(ranks, F.col(angle)))
    h = stats.kruskal_of(profiled, ["feature"])
    rho = stats.spearman_of(profiled, ["feature"]).withColumnsRenamed({"n": "rho_n", "p": "rho_p"})
    return null_safe_join(h, rho, ["feature"], "left").withColumns(
        {"h_significance": N.significance(F.col("p")), "rho_significance": N.significance(F.col("rho_p"))}
    )


def score_shares(df: DataFrame, angle: str = "angle", score: str = "score") -> DataFrame:
    """Share of each score within an angle in percent, absent combinations as zero; flat shares speak against confounding."""
    known = df.filter(F.col(angle).isNotNull() & F.col(score).isNotNull())
    cells = durable(known.groupBy(angle, score).agg(F.count(F.lit(1)).alias("n")))
    scores = cells.agg(F.array_sort(F.collect_set(score)).alias("s")).scalar()  # scores are a short scale
    grid = cells.groupBy(angle).agg(F.sum("n").alias("_t")).withColumn(score, F.explode(scores))
    filled = grid.join(cells, [angle, score], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(angle, score, "n", (100.0 * F.col("n") / F.col("_t")).alias("percent"))


# video-quality factors


def factor_correlations(df: DataFrame, factors: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Pearson of each quality factor with each feature over the rows where all of them are present."""
    names = [*factors, *features]
    typed = df.select(*[N.finite(F.col(c)).alias(c) for c in names])
    whole = typed.dropna(subset=names)
    cells = [
        F.struct(F.lit(a).alias("factor"), F.lit(b).alias("feature"), F.corr(a, b).alias("r")) for a in factors for b in features
    ]
    table = whole.agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("c")).select("n", F.explode("c").alias("c"))
    return table.filter(F.col("n") >= FEWEST_COMPLETE).select("n", "c.*")


def factor_trends(df: DataFrame, factors: Sequence[str], quality: str) -> DataFrame:
    """Spearman of each factor with the signal quality, and the line through the points; needs five of them."""
    rows = df.withColumn("_q", N.finite(F.col(quality)))
    long = stats.long_features(rows, ["_q"], factors).withColumn("value", N.finite(F.col("value")))
    pairs = durable(long.filter(F.col("_q").isNotNull() & F.col("value").isNotNull()).withColumnRenamed("feature", "factor"))
    line = pairs.groupBy("factor").agg(
        F.regr_slope("_q", "value").alias("slope"), F.regr_intercept("_q", "value").alias("intercept")
    )
    rho = stats.spearman(pairs, ["factor"], "value", "_q").filter(F.col("n") >= 5)
    return rho.join(line, "factor")
