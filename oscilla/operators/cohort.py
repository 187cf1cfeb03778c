"""Relational cohort operators: filters, label joins, merges, collapses and composites."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators.ordering import exact_percentiles
from oscilla.session import durable

# Composite components as (feature, sign[, weight]).
COMPOSITE = [("mean_amplitude", -1.0), ("peak_velocity", -1.0), ("mean_velocity", -1.0)]
COMPOSITE_V2 = [
    ("peak_velocity", -1.0, 2.0),
    ("mean_amplitude", -1.0, 1.5),
    ("global_velocity", -1.0, 1.5),
    ("rhythm_cv", 1.0, 1.0),
    ("amp_decrement_pct", 1.0, 1.0),
    ("pause_time_ratio", 1.0, 1.0),
    ("arm_swing", 1.0, 0.5),
]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys: missing keys match missing keys."""
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(right[k])
    return match


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join whose NULL keys match, keeping one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def available(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Features that exist in ``df``; the others are silently left out."""
    return [n for n in names if n in df.columns]


# filters


def only_videos(df: DataFrame, column: str = "record_type") -> DataFrame:
    return df.filter(F.col(column) == "VIDEO") if column in df.columns else df


def at_least(column: str, threshold: float) -> Column:
    """Threshold predicate that counts missing or unparsable values as zero."""
    return F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)) >= threshold


def threshold_filter(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Apply the positive thresholds; a missing column skips its filter."""
    for column, threshold in thresholds.items():
        if threshold > 0 and column in df.columns:
            df = df.filter(at_least(column, threshold))
    return df


def segment_mask(name: Column, segmented_only: bool, whole_only: bool) -> Column:
    if segmented_only and whole_only:
        return F.lit(False)
    segmented = F.lower(F.coalesce(name, F.lit(""))).contains("segmented")
    if segmented_only:
        return segmented
    return ~segmented if whole_only else F.lit(True)


def best_quality_labels(labels: DataFrame, path: str, label: str) -> DataFrame:
    """Valid labels 1..3, the best (lowest) one per file key."""
    missing = {path, label} - set(labels.columns)
    if missing:
        raise ValueError(f"quality labels lack column(s): {sorted(missing)}")
    value = F.col(label).try_cast("double").cast("int")
    return (
        labels.select(N.path_match_key(F.col(path)).alias("quality_key"), value.alias("quality_label"))
        .filter(F.col("quality_label").between(1, 3))
        .groupBy("quality_key")
        .agg(F.min("quality_label").alias("quality_label"))
    )


def quality_filter(df: DataFrame, best: DataFrame, path: str, threshold: int) -> DataFrame:
    """Keep rows labelled ``threshold`` or better; unlabelled rows go."""
    if threshold not in (1, 2, 3):
        raise ValueError("threshold must be 1, 2 or 3")
    keep = best.filter(F.col("quality_label") <= threshold)
    keyed = df.withColumn("quality_key", N.path_match_key(F.col(path)))
    return keyed.join(keep, "quality_key", "inner").drop("quality_key")


def angle_allow_list(names: Iterable[str]) -> list[str]:
    """Canonical names of an angle filter given in any spelling (driver-side, a few words)."""
    words = [n.strip().lower() for n in names if n and n.strip()]
    return sorted({N.ANGLE_ALIASES.get(w, w) for w in words})


def attach_labels(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Left join of one label per key; the smallest label wins where a key repeats."""
    one = labels.filter(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    return df.join(one, key, "left")


# id maps and score lookups


def id_map(lines: DataFrame, line_no: str, patient: str, ids: str) -> DataFrame:
    """video id -> patient id from lines of tuple text; the last line wins per video id."""
    quoted = F.regexp_extract_all(F.col(ids), F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    bare = F.regexp_extract_all(F.col(ids), F.lit(r"(POM\d+VD\d+)"), F.lit(1))
    plain = F.filter(
        F.transform(F.split(F.regexp_replace(F.col(ids), r"[()\[\]]", ""), ","), F.trim),
        lambda s: s != "",
    )
    names = F.when(F.size(quoted) > 0, quoted).when(F.size(bare) > 0, bare).otherwise(plain)
    exploded = lines.select(
        F.col(line_no).alias("_line"),
        F.trim(F.col(patient)).alias("patient_id"),
        F.explode(F.array_distinct(names)).alias("video_id"),
    )
    return exploded.groupBy("video_id").agg(F.max_by("patient_id", "_line").alias("patient_id"))


def map_patients(df: DataFrame, mapping: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Look patients up by ``video_id``; unmatched rows are dropped or keep their own id."""
    if not keep_unmatched:
        return df.join(mapping, "video_id", "inner").withColumn("unmapped", F.lit(False))
    joined = df.join(mapping, "video_id", "left")
    return joined.select(
        *df.columns,
        F.coalesce("patient_id", "video_id").alias("patient_id"),
        F.col("patient_id").isNull().alias("unmapped"),
    )


def updrs_long(wide: DataFrame, key: str, score: str) -> DataFrame:
    """Unpivot ``updrs_v<visit>_<med>`` columns; blanks are dropped."""
    lower = wide.toDF(*[c.lower() for c in wide.columns])
    present = [c for c in (f"updrs_v{v}_{m}" for v in (1, 2, 3) for m in ("off", "on")) if c in lower.columns]
    typed = lower.select(key, *[F.col(c).try_cast("double").alias(c) for c in present])
    long = typed.unpivot(key, present, "_name", score).filter(F.col(score).isNotNull())
    return long.select(
        key,
        F.regexp_extract("_name", r"updrs_v(\d)", 1).cast("int").alias("visit"),
        F.initcap(F.regexp_extract("_name", r"_(off|on)$", 1)).alias("med"),
        score,
    )


def resolve_scores(
    asked: DataFrame, scores: DataFrame, patient: str, keys: Sequence[str], score: str
) -> DataFrame:
    """Score of a recording when the keys that are known pick out one distinct score.

    An unknown key must not restrict the lookup.  Instead of testing every score row of a patient
    against every recording, the scores are pre-aggregated once per combination of keys, so the
    lookup is a plain equi-join of one row per recording.
    """
    sets = [[patient, *c] for n in range(len(keys) + 1) for c in combinations(keys, n)]
    mask = F.concat(*[F.grouping(k).cast("string") for k in keys])
    table = scores.groupingSets([[F.col(c) for c in s] for s in sets], patient, *keys).agg(
        mask.alias("_mask"), F.min(score).alias("_lo"), F.max(score).alias("_hi")
    )
    unique = table.filter(F.col("_lo") == F.col("_hi")).withColumnRenamed("_lo", score).drop("_hi")
    known = asked.withColumn(
        "_mask", F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])
    )
    return null_safe_join(known, unique, ["_mask", patient, *keys], "left").drop("_mask")


# merge, collapse, summarise


def merge_scores(videos: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recordings joined to clinical scores; missing keys match missing keys."""
    return null_safe_join(videos, scores, keys, "inner")


def collapse_same_condition(
    df: DataFrame, keys: Sequence[str], numeric: Sequence[str], other: Sequence[str], order: str
) -> DataFrame:
    """One row per condition: exact medians of numbers, first non-null of everything else.

    One aggregate and one shuffle: the buffers of a median (counts of distinct values) combine before
    it.  A condition is one subject under one treatment, whose recordings fit a task.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_recordings"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in other],
        *[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in numeric],
    )


def summary_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, std (n-1), median, min and max per group."""
    clean = durable(df.filter(F.col(value).isNotNull()).select(key, value))
    base = clean.groupBy(key).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return null_safe_join(base, exact_percentiles(clean, [key], value, {"median": 0.5}), [key])


# composites


def _control_stats(df: DataFrame, score: str, features: Sequence[str]) -> DataFrame:
    """Moments of the healthy (score 0) group as one row."""
    healthy = [F.when(F.col(score) == 0, F.col(f)) for f in features]
    aggs = []
    for f, value in zip(features, healthy, strict=True):
        aggs += [
            F.avg(value).alias(f"mu_{f}"),
            F.stddev_samp(value).alias(f"sd_{f}"),
            F.count(value).alias(f"n_{f}"),
        ]
    return df.agg(F.count_if(F.col(score) == 0).alias("n_controls"), F.struct(*aggs).alias("m"))


def _scalar_stats(df: DataFrame, score: str, features: Sequence[str]) -> DataFrame:
    stats = _control_stats(df, score, features).select(F.struct("n_controls", "m").alias("s"))
    return df.withColumn("_s", stats.scalar())


def composite_score(df: DataFrame, score: str = "score", components=COMPOSITE) -> DataFrame:
    """Mean of signed z-scores against the score-0 group; NULL as a whole when a spread is 0."""
    names = [c[0] for c in components]
    if len(available(df, names)) < len(names):
        return df.withColumn("composite_score", F.lit(None).cast("double"))
    with_stats = _scalar_stats(df, score, names)
    usable = F.lit(True)
    zs = []
    for name, sign in components:
        sd = F.col(f"_s.m.sd_{name}")
        usable = usable & (F.coalesce(sd, F.lit(0.0)) != 0)
        zs.append(F.lit(sign) * (F.col(name) - F.col(f"_s.m.mu_{name}")) / F.nullif(sd, F.lit(0.0)))
    present = sum((F.when(z.isNotNull(), 1).otherwise(0) for z in zs), F.lit(0))
    total = sum((F.coalesce(z, F.lit(0.0)) for z in zs), F.lit(0.0))
    return with_stats.withColumn(
        "composite_score", F.when(usable & (present > 0), total / present)
    ).drop("_s")


def composite_v2(df: DataFrame, score: str = "score", components=COMPOSITE_V2) -> DataFrame:
    """Weighted z composite over the usable components (at least three, and three controls)."""
    parts = [c for c in components if c[0] in df.columns]
    with_stats = _scalar_stats(df, score, [c[0] for c in parts])
    total, weights, used, complete = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(True)
    for name, sign, weight in parts:
        sd = F.col(f"_s.m.sd_{name}")
        ok = (F.col(f"_s.m.n_{name}") >= 3) & (F.coalesce(sd, F.lit(0.0)) >= 1e-9)
        z = F.lit(sign) * (F.col(name) - F.col(f"_s.m.mu_{name}")) / F.nullif(sd, F.lit(0.0))
        total = total + F.when(ok, F.coalesce(z, F.lit(0.0)) * weight).otherwise(0.0)
        weights = weights + F.when(ok, F.lit(weight)).otherwise(0.0)
        used = used + F.when(ok, 1).otherwise(0)
        complete = complete & (~ok | F.col(name).isNotNull())
    valid = (F.col("_s.n_controls") >= 3) & (used >= 3) & complete
    return with_stats.withColumn(
        "clinical_composite_v2", F.when(valid, total / F.nullif(weights, F.lit(0.0)))
    ).drop("_s")


def interaction_features(df: DataFrame) -> DataFrame:
    """Derived features whose inputs are all present."""
    has = set(df.columns)
    out: dict[str, Column] = {}
    if {"mean_amplitude", "peak_velocity"} <= has:
        out["movement_vigor"] = F.col("mean_amplitude") * F.col("peak_velocity") / 100.0
    if {"mean_amplitude", "mean_velocity"} <= has:
        out["amp_vel_product"] = F.col("mean_amplitude") * F.col("mean_velocity") / 100.0
    if {"amp_decrement_pct", "velocity_decrement_pct"} <= has:
        out["fatigue_index"] = F.coalesce(
            F.when(F.col("amp_decrement_pct") > 0, F.col("amp_decrement_pct")), F.lit(0.0)
        ) + F.coalesce(
            F.when(F.col("velocity_decrement_pct") > 0, F.col("velocity_decrement_pct")), F.lit(0.0)
        )
    if {"amplitude_cv", "pause_time_ratio", "total_cycles"} <= has:
        hesitations = F.col("num_hesitations") if "num_hesitations" in has else F.lit(0)
        out["irregularity_burden"] = (
            F.col("amplitude_cv")
            * (1.0 + F.col("pause_time_ratio"))
            * (1.0 + hesitations / F.nullif(F.col("total_cycles"), F.lit(0)))
        )
    return df.withColumns(out) if out else df


# outliers and covariates


def extreme_outliers(df: DataFrame, value: str, factor: float = 3.0) -> DataFrame:
    """Flag values outside the interquartile fences when they stretch the range past twofold.

    Adds ``is_extreme`` (NULL values are not extreme) and ``has_extremes`` for the whole column.
    """
    quartiles = exact_percentiles(df.select(value), [], value, {"q1": 0.25, "q3": 0.75})
    bounds = quartiles.select(
        F.struct(
            (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("lower"),
            (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("upper"),
        ).alias("b")
    ).scalar()
    fenced = df.withColumn("_b", bounds)
    extreme = (F.col(value) < F.col("_b.lower")) | (F.col(value) > F.col("_b.upper"))
    flagged = fenced.withColumn("is_extreme", F.coalesce(extreme, F.lit(False)))
    inner = F.when(~F.col("is_extreme"), F.col(value))
    spans = flagged.agg(
        F.count(value).alias("n"),
        (F.max(value) - F.min(value)).alias("full"),
        (F.max(inner) - F.min(inner)).alias("inner"),
        F.count_if("is_extreme").alias("n_extreme"),
    ).select(
        F.coalesce(
            (F.col("n") >= 4)
            & (F.col("n_extreme") > 0)
            & (F.col("inner") > 0)
            & (F.col("full") > 2 * F.col("inner")),
            F.lit(False),
        ).alias("has_extremes")
    )
    return flagged.withColumn("has_extremes", spans.scalar()).drop("_b")


def residualise(df: DataFrame, value: str, age: str, gender: str) -> DataFrame:
    """Residual of ``value`` on age and gender plus the grand mean, from one pass of sums.

    The normal equations of a two-regressor fit need only means and central cross moments, which
    combine map-side; the closed-form solution is applied as one scalar struct.
    """
    complete = F.col(value).isNotNull() & F.col(age).isNotNull() & F.col(gender).isNotNull()
    x1 = F.when(complete, F.col(age))
    x2 = F.when(complete, F.when(F.col(gender) == 2, 1.0).otherwise(0.0))
    y = F.when(complete, F.col(value).cast("double"))
    m = df.agg(
        F.count(y).alias("n"),
        F.avg(x1).alias("m1"),
        F.avg(x2).alias("m2"),
        F.avg(y).alias("my"),
        F.covar_pop(x1, x1).alias("s11"),
        F.covar_pop(x2, x2).alias("s22"),
        F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("s1y"),
        F.covar_pop(x2, y).alias("s2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    full = F.abs(det) > 1e-12
    b1 = F.when(full, (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det).otherwise(
        F.coalesce(F.col("s1y") / F.nullif(F.col("s11"), F.lit(0.0)), F.lit(0.0))
    )
    b2 = F.when(full, (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det).otherwise(
        F.when(F.col("s11") > 0, 0.0).otherwise(
            F.coalesce(F.col("s2y") / F.nullif(F.col("s22"), F.lit(0.0)), F.lit(0.0))
        )
    )
    fit = m.select(F.struct("n", "m1", "m2", "my", b1.alias("b1"), b2.alias("b2")).alias("f")).scalar()
    fitted = F.col("_f.b1") * (x1 - F.col("_f.m1")) + F.col("_f.b2") * (x2 - F.col("_f.m2"))
    return (
        df.withColumn("_f", fit)
        .withColumn(
            "adjusted",
            F.when(F.col("_f.n") < 5, F.col(value).cast("double")).otherwise(y - fitted),
        )
        .drop("_f")
    )
