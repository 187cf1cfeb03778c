"""End-to-end queries: detections to log, log to cohort tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.operators import reports
from oscilla.plans.cohort_reports import SCORES_SQL, clinical_scores
from oscilla.plans.cohort_reports import zscore_sql as _z
from oscilla.plans.registry import query
from oscilla.sources.fixtures import FEATURES, detections, feature_log, patients, with_ctes

FPS = 25.0


@query("recording_log")
def recording_log(spark, sf_dir):
    dets = detections(spark, sf_dir)
    videos = dets.groupBy("video").agg((F.max("frame_idx") + 1).alias("total_frames"))
    sized = videos.withColumns({"width": F.lit(640), "height": F.lit(480)})
    return reports.recording_log(dets, sized, FPS)


def _merged(spark, sf_dir):
    p = patients(spark, sf_dir).select("patient", "age", "gender_code")
    return reports.merge_cohort(
        feature_log(spark, sf_dir).drop("score"),
        clinical_scores(spark, sf_dir),
        FEATURES,
        thresholds={"quality": 0.1, "total_cycles": 2},
        demographics=p,
    )


_MEDIANS = ", ".join(f"median({f}) AS {f}" for f in FEATURES)


@query(
    "merged_cohort",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        "patients",
        body=SCORES_SQL
        + f"""
, kin AS (SELECT * EXCLUDE (score) FROM featlog WHERE record_type = 'VIDEO' AND coalesce(quality, 0) >= 0.1 AND coalesce(total_cycles, 0) >= 2)
, mg AS (SELECT k.*, s.score, p.age FROM kin k JOIN scores s ON k.patient IS NOT DISTINCT FROM s.patient AND k.visit IS NOT DISTINCT FROM s.visit
   AND k.med IS NOT DISTINCT FROM s.med AND k.hand IS NOT DISTINCT FROM s.hand LEFT JOIN patients p ON p.patient = k.patient)
, c AS (SELECT patient, visit, med, hand, count(*) AS n_recordings, median(score) AS score, median(age) AS age, {_MEDIANS} FROM mg GROUP BY patient, visit, med, hand)
, d AS (SELECT * FROM c WHERE score = round(score))
, h AS (SELECT * FROM d WHERE score = 0)
SELECT patient, visit, med, hand, n_recordings, CAST(score AS INT) AS score, age, round(mean_amplitude, 8) AS mean_amplitude,
  round(mean_amplitude * peak_velocity / 100, 5) AS movement_vigor,
  round(({_z('mean_amplitude', '-')} + {_z('peak_velocity', '-')} + {_z('mean_velocity', '-')}) / 3, 6) AS composite_score,
  round((2 * {_z('peak_velocity', '-')} + 1.5 * {_z('mean_amplitude', '-')} + 1.5 * {_z('global_velocity', '-')} + {_z('rhythm_cv', '')}
    + {_z('pause_time_ratio', '')} + 0.5 * {_z('arm_swing', '')}) / 7.5, 6) AS clinical_composite_v2 FROM d""",
    ),
)
def merged_cohort(spark, sf_dir):
    return _merged(spark, sf_dir).select(
        "patient", "visit", "med", "hand", "n_recordings", "score", "age",
        F.round("mean_amplitude", 8).alias("mean_amplitude"),
        F.round("movement_vigor", 5).alias("movement_vigor"),
        F.round("composite_score", 6).alias("composite_score"),
        F.round("clinical_composite_v2", 6).alias("clinical_composite_v2"),
    )


@query("cohort_report")
def cohort_report(spark, sf_dir):
    tables = reports.cohort_report(_merged(spark, sf_dir), [*FEATURES, "composite_score"])
    rho = tables["correlation"].select("feature", "n", "rho", F.col("p").alias("rho_p"))
    h = tables["omnibus"].select("feature", "h", F.col("p").alias("h_p"))
    f = tables["covariates"].select("feature", "f", F.col("p").alias("f_p"))
    d = tables["directions"]
    return rho.join(h, "feature").join(f, "feature").join(d, "feature", "left")
