"""Selection of training recordings: eligibility score, budget threshold, split, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators.jobs import seeded_share
from oscilla.operators.ordering import exact_percentiles, running_sum
from oscilla.operators.sequence import array_median

# Weights of the eligibility score.
ELIGIBILITY_WEIGHTS = {
    "signal_quality": 3.0,
    "detection_rate": 2.0,
    "mcp_confidence": 2.0,
    "sharpness": 1.5,
    "gap_complement": 1.5,
    "bbox_area": 1.0,
    "luminance_quality": 0.5,
}


def _or(column: str, default: float) -> Column:
    return F.coalesce(N.finite(F.col(column).cast("double")), F.lit(default))


def eligibility(df: DataFrame) -> DataFrame:
    """Add ``ple``: weighted quality in [0, 1]; sharpness and box area are scaled to the data set."""
    clean = df.withColumns(
        {
            "_sq": _or("signal_quality", 0.0),
            "_dr": _or("detection_rate", 0.0),
            "_mc": _or("mcp_confidence", 0.0),
            "_sh": _or("sharpness", 0.0),
            "_gap": _or("gap_fraction", 1.0),
            "_bb": _or("bbox_area", 0.0),
            "_lum": _or("luminance", 128.0),
        }
    )
    limits = clean.agg(
        F.struct(
            F.min("_sh").alias("s0"), F.max("_sh").alias("s1"), F.min("_bb").alias("b0"), F.max("_bb").alias("b1")
        ).alias("m")
    )
    scaled = clean.withColumn("_m", limits.scalar())

    def share(value: str, low: str, high: str) -> Column:
        span = F.greatest(F.col(f"_m.{high}") - F.col(f"_m.{low}"), F.lit(1e-8))
        return (F.col(value) - F.col(f"_m.{low}")) / span

    light = 1.0 - F.abs(F.col("_lum") - 128.0) / 128.0
    parts = {
        "signal_quality": F.col("_sq"),
        "detection_rate": F.col("_dr"),
        "mcp_confidence": F.col("_mc"),
        "sharpness": share("_sh", "s0", "s1"),
        "gap_complement": 1.0 - F.col("_gap"),
        "bbox_area": share("_bb", "b0", "b1"),
        "luminance_quality": F.greatest(F.lit(0.0), F.least(F.lit(1.0), light)),
    }
    total = sum((parts[k] * w for k, w in ELIGIBILITY_WEIGHTS.items()), F.lit(0.0))
    ple = total / sum(ELIGIBILITY_WEIGHTS.values())
    return scaled.withColumn("ple", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ple))).drop(
        "_sq", "_dr", "_mc", "_sh", "_gap", "_bb", "_lum", "_m"
    )


def selection_threshold(
    df: DataFrame,
    score: str,
    frames: str,
    order: str,
    min_frames: int = 5000,
    max_frames: int = 25000,
    min_videos: int = 50,
) -> DataFrame:
    """One row: the score at the elbow of score against cumulative frames, within the budget.

    The descending order is cut into slices, so ranks and cumulative frames need no global window;
    neighbours in rank meet by an equi-join.  Cumulative frames only grow, so every budget rule is
    a comparison of ranks.
    """
    keyed = df.select(
        (-F.col(score)).alias("_neg"), F.col(order).alias("_o"), F.col(frames).alias("_f"), F.lit(1).alias("_one")
    )
    ranked = running_sum(keyed, [], ["_neg", "_o"], {"cum": "_f", "rank": "_one"}).select(
        (F.col("rank") - 1).alias("i"), "cum", (-F.col("_neg")).alias("score")
    )
    previous = ranked.select((F.col("i") + 1).alias("i"), F.col("cum").alias("_c"), F.col("score").alias("_s"))
    steps = ranked.join(previous, "i").withColumn(
        "gradient", F.abs(F.col("score") - F.col("_s")) / F.greatest(F.col("cum") - F.col("_c"), F.lit(1.0))
    )
    median = exact_percentiles(
        steps.filter(F.col("gradient") > 0).select("gradient"), [], "gradient", {"m": 0.5}
    ).scalar()
    steep = F.col("gradient") > 2.0 * F.coalesce(median, F.lit(1e-8))
    elbow = (
        steps.filter(steep & (F.col("cum") >= min_frames)).agg(F.min("i").alias("i"))
    ).scalar()
    marks = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("cum") <= max_frames, F.col("i"))).alias("last_within"),
        F.min(F.when(F.col("cum") >= min_frames, F.col("i"))).alias("first_enough"),
    ).withColumn("elbow", elbow)
    end = F.col("n") - 1
    chosen = F.coalesce("elbow", "last_within", end)
    enough = F.greatest(chosen, F.coalesce("first_enough", end))
    capped = F.least(enough, F.coalesce("last_within", enough))
    wanted = F.greatest(capped, F.least(F.lit(min_videos - 1), end))
    index = marks.select(F.when(F.col("n") < 3, end).otherwise(wanted)).scalar()
    return ranked.filter(F.col("i") == index).select(
        F.col("i").alias("rank"), "score", F.col("cum").alias("frames")
    )


def train_val_split(df: DataFrame, video: str, val_share: float, seed: int) -> DataFrame:
    """All frames of a recording fall on the same side, decided by a seeded hash of its id."""
    share = seeded_share(F.col(video), seed)
    return df.withColumn("split", F.when(share < val_share, "val").otherwise("train"))


# agreement of two detectors


def icc_simplified(x: Column, y: Column) -> Column:
    """Agreement from the variances of mean and difference (aggregate); NULL below three pairs."""
    both = x.isNotNull() & y.isNotNull()
    diff, mean = F.when(both, x - y), F.when(both, (x + y) / 2.0)
    n = F.count(diff)
    vd, vm = F.var_samp(diff), F.var_samp(mean)
    degenerate = F.when(vd == 0, 1.0).otherwise(0.0)
    total = vm + vd / 2.0
    return F.when(
        n >= 3,
        F.when(total == 0, degenerate).otherwise((vm - vd / 2.0) / F.nullif(total, F.lit(0.0))),
    )


def steadiness(a: DataFrame, b: DataFrame, key: str, series: str) -> DataFrame:
    """Frame-to-frame confidence of two detectors: the mean of the medians of their recordings, and the gain of ``b`` in %.

    Recordings that both logged count; a series without a finite value has no median.  Without any median a mean is 0.
    The higher the confidence, the less the points jitter.
    """

    def medians(log: DataFrame, name: str) -> DataFrame:
        finite = F.filter(series, lambda v: N.finite(v.cast("double")).isNotNull())
        return log.select(key, array_median(finite).alias(name))

    joined = medians(a, "_a").join(medians(b, "_b"), key)
    row = joined.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("_a", "mean_conf_a"), ("_b", "mean_conf_b"))])
    gain = (F.col("mean_conf_b") - F.col("mean_conf_a")) / F.greatest(F.abs("mean_conf_a"), F.lit(1e-8)) * 100.0
    return row.withColumn("improvement_pct", gain)


def agreement(a: DataFrame, b: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """ICC of each feature over the recordings both detectors logged."""
    right = b.select(key, *[F.col(f).alias(f"_b_{f}") for f in features])
    joined = a.select(key, *features).join(right, key)
    row = joined.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.count(F.when(F.col(f"_b_{f}").isNotNull(), F.col(f))).alias("n"),
                    icc_simplified(N.finite(F.col(f).cast("double")), N.finite(F.col(f"_b_{f}").cast("double"))).alias("icc"),
                )
                for f in features
            ]
        ).alias("r")
    )
    return row.select(F.explode("r").alias("r")).select("r.*")


def rescue_rate(
    a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str], difficult: Column, lower_is_better: Sequence[str] = ()
) -> DataFrame:
    """Mean of each metric before and after on the difficult recordings, with its change in percent."""
    right = b.select(key, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    joined = a.filter(difficult).join(right, key)
    cells = []
    for m in metrics:
        before, after = F.avg(F.col(m)), F.avg(F.col(f"_b_{m}"))
        gain = before - after if m in lower_is_better else after - before
        cells.append(
            F.struct(
                F.lit(m).alias("metric"),
                before.alias("mean_before"),
                after.alias("mean_after"),
                gain.alias("improvement"),
                (gain / F.greatest(F.abs(before), F.lit(1e-8)) * 100.0).alias("pct_improvement"),
            )
        )
    return joined.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def assessment(icc: DataFrame, rescue: DataFrame, amplitude: str, frequency: str, detection: str) -> DataFrame:
    """Pass or fail: both agreements above 0.90, detection rescued by more than 15 %."""
    row = icc.agg(
        F.max(F.when(F.col("feature") == amplitude, F.col("icc"))).alias("amplitude_icc"),
        F.max(F.when(F.col("feature") == frequency, F.col("icc"))).alias("frequency_icc"),
    )
    pct = rescue.agg(F.max(F.when(F.col("metric") == detection, F.col("pct_improvement"))).alias("p")).scalar()
    return row.withColumn("detection_rescue_pct", pct).withColumns(
        {
            "icc_pass": F.coalesce(
                (F.col("amplitude_icc") > 0.90) & (F.col("frequency_icc") > 0.90), F.lit(False)
            ),
            "rescue_pass": F.coalesce(F.col("detection_rescue_pct") > 15.0, F.lit(False)),
        }
    )
