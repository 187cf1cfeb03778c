"""Recording-level quality from frame metrics, and data-set-level signal quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscilla.config import DEFAULTS, Settings

# Weights of the data-set quality score.
DATASET_WEIGHTS = {
    "yield_rate": 1.5,
    "coverage": 1.0,
    "spectral_concentration": 2.0,
    "autocorr_strength": 2.0,
    "cycle_shape_consistency": 1.5,
    "freq_physio_rate": 1.0,
    "low_nan_frac": 1.0,
}


def frame_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians and spreads of per-frame sharpness, luminance, contrast and saturation.

    Recordings are bounded, so the exact percentile of a recording is a bounded aggregate.
    """

    def pct(c: str, p: float) -> Column:
        return F.percentile(c, F.lit(p))

    return df.groupBy(*keys).agg(
        pct("sharpness", 0.5).alias("sharpness_median"),
        pct("sharpness", 0.1).alias("sharpness_q10"),
        pct("sharpness", 0.25).alias("sharpness_q25"),
        pct("luminance", 0.5).alias("luminance_median"),
        F.avg("luminance").alias("luminance_mean"),
        (F.stddev_pop("luminance") / F.greatest(F.avg("luminance"), F.lit(1e-6))).alias("luminance_cv"),
        pct("contrast", 0.5).alias("contrast_median"),
        pct("saturation", 0.5).alias("saturation_median"),
        pct("temporal_diff", 0.5).alias("temporal_diff_median"),
        (
            F.stddev_pop("temporal_diff") / F.greatest(F.avg("temporal_diff"), F.lit(1e-6))
        ).alias("temporal_diff_cv"),
    )


def bitrate_kbps(file_bytes: Column, frames: Column, fps: Column) -> Column:
    duration = frames / F.nullif(fps, F.lit(0.0))
    return 8.0 * file_bytes / F.nullif(duration * 1000.0, F.lit(0.0))


def confidence_means(df: DataFrame, columns: Sequence[str], mask: str, keys: Sequence[str]) -> DataFrame:
    """Mean confidence per knuckle over the used frames (all frames when none is used)."""
    used = F.count_if(F.col(mask) > 0.5)
    out = df.groupBy(*keys).agg(
        *[
            F.when(used > 0, F.avg(F.when(F.col(mask) > 0.5, F.col(c))))
            .otherwise(F.avg(c))
            .alias(f"mean_{c}")
            for c in columns
        ]
    )
    means = [F.col(f"mean_{c}") for c in columns]
    present = sum((F.when(m.isNotNull(), 1).otherwise(0) for m in means), F.lit(0))
    total = sum((F.coalesce(m, F.lit(0.0)) for m in means), F.lit(0.0))
    return out.withColumn("mean_conf_overall", total / F.nullif(present, F.lit(0)))


def dataset_quality(logs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: the seven sub-scores of a tracking log and their weighted mean.

    Expects ``mean_amplitude``, ``adjusted_pct``, ``spectral_concentration``, ``autocorr_strength``,
    ``cycle_shape_consistency``, ``mean_frequency`` and ``nan_fraction`` per recording; the last four
    are NULL where the signal was too short to judge.
    """
    has = F.col("mean_amplitude").isNotNull()
    judged = has & F.col("nan_fraction").isNotNull()
    inside = F.col("mean_frequency").between(settings.freq_low_hz, settings.freq_high_hz)

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(F.when(judged, F.col(c))), F.lit(0.0))

    n = F.count(F.lit(1))
    row = logs.agg(
        n.alias("n_total"),
        F.count_if(has).alias("n_with_features"),
        F.count_if(judged).alias("n_signal_evaluated"),
        (F.count_if(has) / F.nullif(n, F.lit(0))).alias("yield_rate"),
        F.coalesce(F.avg("adjusted_pct") / 100.0, F.lit(0.0)).alias("coverage"),
        mean("spectral_concentration").alias("spectral_concentration"),
        mean("autocorr_strength").alias("autocorr_strength"),
        mean("cycle_shape_consistency").alias("cycle_shape_consistency"),
        F.coalesce(
            F.count_if(judged & inside) / F.nullif(F.count_if(judged), F.lit(0)), F.lit(0.0)
        ).alias("freq_physio_rate"),
        F.coalesce(1.0 - F.avg(F.when(judged, F.col("nan_fraction"))), F.lit(0.0)).alias("low_nan_frac"),
    )
    clipped = {c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) for c in DATASET_WEIGHTS}
    total = sum((clipped[c] * w for c, w in DATASET_WEIGHTS.items()), F.lit(0.0))
    return row.withColumns(clipped).withColumn(
        "signal_quality_score", total / sum(DATASET_WEIGHTS.values())
    )
