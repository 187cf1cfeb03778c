"""Cohort-level queries: merge, collapse, composites, outliers, covariate adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators import cohort
from oscilla.plans.registry import query
from oscilla.sources.fixtures import (
    FEATURES,
    feature_log,
    patients,
    recording_logs,
    with_ctes,
)

KEYS = ["patient", "visit", "med", "hand"]


def clinical_scores(spark, sf_dir):
    """One score per condition; conditions without a medication state keep a NULL key."""
    logs = recording_logs(spark, sf_dir)
    return logs.groupBy(*KEYS).agg(F.min("score").alias("score"))


SCORES_SQL = ", scores AS (SELECT patient, visit, med, hand, min(score) AS score FROM logs GROUP BY ALL)"


@query(
    "cohort_summary",
    with_ctes(
        "logs",
        "patients",
        body=SCORES_SQL
        + """
, kin AS (SELECT video, patient, visit, med, hand, feature, video_path FROM logs SEMI JOIN patients USING (patient)
          WHERE record_type = 'VIDEO' AND coalesce(quality, 0) >= 0.2)
, merged AS (SELECT k.*, s.score FROM kin k JOIN scores s ON k.patient IS NOT DISTINCT FROM s.patient
   AND k.visit IS NOT DISTINCT FROM s.visit AND k.med IS NOT DISTINCT FROM s.med AND k.hand IS NOT DISTINCT FROM s.hand)
, collapsed AS (SELECT patient, visit, med, hand, median(feature) AS feature, median(score) AS score FROM merged GROUP BY ALL)
SELECT CAST(score AS INT) AS score, count(*) AS n, round(avg(feature), 4) AS mean, round(stddev_samp(feature), 4) AS std,
       round(min(feature), 4) AS min, round(max(feature), 4) AS max, round(median(feature), 4) AS median
FROM collapsed GROUP BY 1""",
    ),
)
def cohort_summary(spark, sf_dir):
    logs = cohort.only_videos(recording_logs(spark, sf_dir))
    kin = cohort.threshold_filter(logs, {"quality": 0.2}).select(
        "video", *KEYS, "feature", "video_path"
    )
    kin = kin.join(patients(spark, sf_dir).select("patient"), "patient", "left_semi")
    merged = cohort.merge_scores(kin, clinical_scores(spark, sf_dir), KEYS)
    collapsed = cohort.collapse_same_condition(merged, KEYS, ["feature", "score"], ["video_path"], "video")
    typed = collapsed.withColumn("score", N.integer_score(F.col("score")))
    out = cohort.summary_by(typed, "score", "feature")
    return out.select(
        "score", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "median")]
    )


@query(
    "condition_collapse",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body="""
SELECT patient, visit, med, hand, count(*) AS n_recordings, arg_min(video_path, video) AS video_path,
       round(median(mean_amplitude), 8) AS mean_amplitude, round(median(peak_velocity), 8) AS peak_velocity
FROM featlog GROUP BY patient, visit, med, hand""",
    ),
)
def condition_collapse(spark, sf_dir):
    df = feature_log(spark, sf_dir).select("video", *KEYS, "video_path", "mean_amplitude", "peak_velocity")
    out = cohort.collapse_same_condition(
        df, KEYS, ["mean_amplitude", "peak_velocity"], ["video_path"], "video"
    )
    return out.select(
        *KEYS,
        "n_recordings",
        "video_path",
        F.round("mean_amplitude", 8).alias("mean_amplitude"),
        F.round("peak_velocity", 8).alias("peak_velocity"),
    )


def zscore_sql(feature: str, sign: str) -> str:
    return f"{sign}({feature} - (SELECT avg({feature}) FROM h)) / (SELECT stddev_samp({feature}) FROM h)"


@query(
    "composite_score",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=f"""
, h AS (SELECT * FROM featlog WHERE score = 0)
SELECT video, round(({zscore_sql('mean_amplitude', '-')} + {zscore_sql('peak_velocity', '-')} + {zscore_sql('mean_velocity', '-')}) / 3, 6)
  AS composite_score FROM featlog""",
    ),
)
def composite_score(spark, sf_dir):
    out = cohort.composite_score(feature_log(spark, sf_dir))
    return out.select("video", F.round("composite_score", 6).alias("composite_score"))


@query(
    "composite_v2",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=f"""
, h AS (SELECT * FROM featlog WHERE score = 0)
SELECT video, round((2 * {zscore_sql('peak_velocity', '-')} + 1.5 * {zscore_sql('mean_amplitude', '-')} + 1.5 * {zscore_sql('global_velocity', '-')}
  + {zscore_sql('rhythm_cv', '')} + {zscore_sql('pause_time_ratio', '')} + 0.5 * {zscore_sql('arm_swing', '')}) / 7.5, 6) AS clinical_composite_v2
FROM featlog""",
    ),
)
def composite_v2(spark, sf_dir):
    out = cohort.composite_v2(feature_log(spark, sf_dir))
    return out.select("video", F.round("clinical_composite_v2", 6).alias("clinical_composite_v2"))


@query(
    "interaction_features",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body="""
SELECT video, round(mean_amplitude * peak_velocity / 100, 5) AS movement_vigor,
       round(mean_amplitude * mean_velocity / 100, 5) AS amp_vel_product,
       round(coalesce(CASE WHEN amplitude_cv - 50 > 0 THEN amplitude_cv - 50 END, 0)
           + coalesce(CASE WHEN rhythm_cv - 60 > 0 THEN rhythm_cv - 60 END, 0), 7) AS fatigue_index,
       round(amplitude_cv * (1 + pause_time_ratio) * (1 + num_hesitations / nullif(total_cycles, 0)), 5) AS irregularity_burden
FROM featlog""",
    ),
)
def interaction_features(spark, sf_dir):
    df = feature_log(spark, sf_dir).withColumns(
        {
            "amp_decrement_pct": F.col("amplitude_cv") - 50,
            "velocity_decrement_pct": F.col("rhythm_cv") - 60,
        }
    )
    out = cohort.interaction_features(df)
    return out.select(
        "video",
        F.round("fatigue_index", 7).alias("fatigue_index"),
        *[
            F.round(c, 5).alias(c)
            for c in ("movement_vigor", "amp_vel_product", "irregularity_burden")
        ],
    )


@query(
    "extreme_outliers",
    """
WITH v AS (SELECT o_orderkey AS video, CASE WHEN o_orderkey % 997 = 5 THEN o_totalprice * 40
             WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS x FROM orders),
b AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v),
f AS (SELECT v.*, coalesce(x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1), false) AS is_extreme FROM v, b)
SELECT is_extreme, (SELECT count(*) FILTER (is_extreme) > 0
    AND max(x) - min(x) > 2 * (max(x) FILTER (NOT is_extreme) - min(x) FILTER (NOT is_extreme)) FROM f) AS has_extremes,
  count(*) AS n, count(x) AS n_values, round(max(x), 4) AS max_value FROM f GROUP BY 1""",
)
def extreme_outliers(spark, sf_dir):
    video = F.col("video")
    df = recording_logs(spark, sf_dir).select(
        "video",
        F.when(video % 997 == 5, F.col("feature") * 40).when(video % 13 != 0, F.col("feature")).alias("x"),
    )
    flagged = cohort.extreme_outliers(df, "x")
    return flagged.groupBy("is_extreme", "has_extremes").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("n_values"), F.round(F.max("x"), 4).alias("max_value")
    )


@query(
    "residualise_age_gender",
    with_ctes(
        "patients",
        body="""
, p AS (SELECT patient, CASE WHEN patient % 17 <> 0 THEN balance END AS y, CASE WHEN patient % 19 <> 0 THEN age END AS x1,
        CASE WHEN gender_code = 2 THEN 1.0 ELSE 0.0 END AS x2 FROM patients)
, c AS (SELECT CAST(y AS DOUBLE) AS y, x1, CAST(x2 AS DOUBLE) AS x2 FROM p WHERE y IS NOT NULL AND x1 IS NOT NULL)
, m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22,
        covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM c)
SELECT patient, round(y - (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * (x1 - m1)
   - (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * (x2 - m2), 4) AS adjusted FROM p, m""",
    ),
)
def residualise_age_gender(spark, sf_dir):
    p = patients(spark, sf_dir).select(
        "patient",
        F.when(F.col("patient") % 17 != 0, F.col("balance")).alias("y"),
        F.when(F.col("patient") % 19 != 0, F.col("age")).alias("age"),
        "gender_code",
    )
    out = cohort.residualise(p, "y", "age", "gender_code")
    return out.select("patient", F.round("adjusted", 4).alias("adjusted"))


@query(
    "threshold_filters",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body="""
SELECT visit, count(*) AS n, round(avg(feature), 4) AS mean_feature FROM featlog
WHERE record_type = 'VIDEO' AND coalesce(quality, 0) >= 0.1 AND coalesce(total_cycles, 0) >= 3
  AND coalesce(TRY_CAST(CASE WHEN video % 9 = 0 THEN 'bad' ELSE CAST(mean_amplitude AS VARCHAR) END AS DOUBLE), 0) >= 10
GROUP BY visit""",
    ),
)
def threshold_filters(spark, sf_dir):
    df = cohort.only_videos(feature_log(spark, sf_dir)).withColumn(
        "amp_text",
        F.when(F.col("video") % 9 == 0, "bad").otherwise(F.col("mean_amplitude").cast("string")),
    )
    kept = cohort.threshold_filter(
        df, {"quality": 0.1, "total_cycles": 3, "amp_text": 10, "pause_time_ratio": 0, "absent": 1}
    )
    return kept.groupBy("visit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("feature"), 4).alias("mean_feature")
    )
