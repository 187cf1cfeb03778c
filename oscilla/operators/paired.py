"""Longitudinal and paired-condition reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators import stats
from oscilla.operators.cohort import null_safe_join

VISITS = (1, 2, 3)


def fill_visit(df: DataFrame, visit: Column, ids: Column, path: Column) -> DataFrame:
    """Visit from its own column, else the id token, else the path token."""
    own, by_id, by_path = N.visit_number(visit), N.visit_from_token(ids), N.visit_from_token(path)
    filled = F.coalesce(own, by_id, by_path)
    return df.withColumns(
        {
            "visit": filled,
            "ids_conflict": F.coalesce(filled != by_id, F.lit(False)),
            "path_conflict": F.coalesce(filled != by_path, F.lit(False)),
        }
    )


def one_video_per_visit(
    df: DataFrame, keys: Sequence[str], visit: str, video: str
) -> tuple[DataFrame, DataFrame]:
    """(rows of the keys that pass, violating keys): at most one distinct video per key and visit.

    Two different videos show as min <> max, so no distinct set is built per group.
    """
    in_scope = df.filter(F.col(visit).isin(*VISITS))
    per_visit = in_scope.groupBy(*keys, visit).agg(
        (F.min(video) != F.max(video)).alias("_several")
    )
    violating = per_visit.filter("_several").select(*keys).distinct()
    renamed = violating.select(*[F.col(k).alias(f"_v_{k}") for k in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_v_{k}"))
    return in_scope.join(renamed, match, "left_anti"), violating


def visit_wide(
    df: DataFrame, keys: Sequence[str], visit: str, value: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Mean per visit side by side, deltas and the per-visit slope; rows with NULL keys go."""
    whole = df
    for k in keys:
        whole = whole.filter(F.col(k).isNotNull())
    wide = whole.groupBy(*keys, *extra).agg(
        *[F.avg(F.when(F.col(visit) == v, F.col(value))).alias(f"v{v}") for v in VISITS]
    )
    v1, v2, v3 = (F.col(f"v{v}") for v in VISITS)
    # least squares over the visits that exist: with all three the middle one cancels
    slope = F.coalesce((v3 - v1) / 2.0, v2 - v1, v3 - v2)
    return wide.withColumns({"d12": v2 - v1, "d23": v3 - v2, "d13": v3 - v1, "slope": slope})


def longitudinal_summary(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, deltas, signed-rank and Friedman tests of the visit-wide table."""
    counts = wide.groupBy(*keys).agg(
        *[F.count(f"v{v}").alias(f"n_visit{v}") for v in VISITS],
        *[F.count(f"d{d}").alias(f"n_pairs_{d}") for d in ("12", "23", "13")],
        F.count_if(
            F.col("v1").isNotNull() & F.col("v2").isNotNull() & F.col("v3").isNotNull()
        ).alias("n_triplets"),
        F.avg("slope").alias("slope_mean"),
    )
    out = counts
    for d in ("12", "23", "13"):
        summary = stats.delta_summary(wide, keys, f"d{d}").drop("n")
        tested = stats.wilcoxon(wide, keys, f"d{d}").select(*keys, F.col("p").alias(f"wilcoxon_p_{d}"))
        renamed = summary.select(
            *keys, *[F.col(c).alias(f"{c}_{d}") for c in summary.columns if c not in keys]
        )
        out = out.join(renamed, list(keys), "left").join(tested, list(keys), "left")
    omnibus = stats.friedman(wide, keys, ["v1", "v2", "v3"])
    return out.join(
        omnibus.select(*keys, F.col("chi2").alias("friedman_chi2"), F.col("p").alias("friedman_p")),
        list(keys),
        "left",
    )


def medication_pairs(
    df: DataFrame, pair_keys: Sequence[str], med: str, video: str, values: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(strict 1:1 Off/On pairs with deltas, counters).

    A key pairs only when exactly one distinct video stands on each side.  One aggregation builds
    both sides, so no self-join is needed.
    """
    usable = df.filter(F.col(med).isin("Off", "On"))
    for k in pair_keys:
        usable = usable.filter(F.col(k).isNotNull())
    aggs = []
    for side in ("Off", "On"):
        here = F.col(med) == side
        low = side.lower()
        aggs += [
            F.min(F.when(here, F.col(video))).alias(f"{low}_video"),
            F.max(F.when(here, F.col(video))).alias(f"_{low}_max"),
            *[F.avg(F.when(here, F.col(v))).alias(f"{v}_{low}") for v in values],
        ]
    wide = usable.groupBy(*pair_keys).agg(*aggs)
    off, on = F.col("off_video").isNotNull(), F.col("on_video").isNotNull()
    several = F.coalesce(F.col("off_video") != F.col("_off_max"), F.lit(False)) | F.coalesce(
        F.col("on_video") != F.col("_on_max"), F.lit(False)
    )
    counters = wide.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(off & on & ~several).alias("n_mapped"),
        F.count_if(off & ~on).alias("n_off_only"),
        F.count_if(on & ~off).alias("n_on_only"),
        F.count_if(several).alias("n_several"),
    )
    pairs = wide.filter(off & on & ~several).select(
        *pair_keys,
        "off_video",
        "on_video",
        *[F.col(f"{v}_{s}") for v in values for s in ("off", "on")],
        *[(F.col(f"{v}_on") - F.col(f"{v}_off")).alias(f"{v}_delta") for v in values],
    )
    return pairs, counters


def medication_summary(pairs: DataFrame, values: Sequence[str]) -> DataFrame:
    """Per feature: means of both sides, delta statistics and both paired tests."""
    long = pairs.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("feature"),
                        F.col(f"{v}_off").alias("off"),
                        F.col(f"{v}_on").alias("on"),
                        F.col(f"{v}_delta").alias("delta"),
                    )
                    for v in values
                ]
            )
        ).alias("e")
    ).select("e.*").filter(F.col("delta").isNotNull())
    means = long.groupBy("feature").agg(F.avg("off").alias("off_mean"), F.avg("on").alias("on_mean"))
    return (
        means.join(stats.delta_summary(long, ["feature"], "delta"), "feature")
        .join(
            stats.wilcoxon(long, ["feature"], "delta").select("feature", F.col("p").alias("wilcoxon_p")),
            "feature",
            "left",
        )
        .join(
            stats.paired_t(long, ["feature"], "delta").select("feature", F.col("p").alias("ttest_rel_p")),
            "feature",
            "left",
        )
    )


def score_response(pairs: DataFrame, values: Sequence[str], score: str) -> DataFrame:
    """Spearman of feature deltas against the clinical score delta, strongest first."""
    long = stats.long_features(
        pairs.select(F.col(f"{score}_delta").alias("s"), *[F.col(f"{v}_delta").alias(v) for v in values]),
        ["s"],
        values,
    )
    out = stats.spearman(long, ["feature"], "s", "value").filter(F.col("rho").isNotNull())
    return out.orderBy(F.abs("rho").desc(), "feature")


def subgroup_deltas(df: DataFrame, groups: Sequence[str], delta: str) -> DataFrame:
    """Delta statistics for each value of each grouping column."""
    long = df.select(
        delta,
        F.explode(
            F.array(
                *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("label")) for g in groups]
            )
        ).alias("g"),
    ).select(delta, "g.*").filter(F.col("label").isNotNull())
    return stats.delta_summary(long, ["grouping", "label"], delta)


def pair_scores(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(df, other, keys, "left")
