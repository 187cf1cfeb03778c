"""Queries of the report steps: totals, summaries, outliers, adjusted features, angles, quality factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.operators import cohort, stats
from oscilla.operators import report_steps as R
from oscilla.plans.ingest import updrs_unpivot
from oscilla.plans.registry import ORACLES, query
from oscilla.plans.statistics import _ANGLE_SQL, _angles, _sql
from oscilla.session import durable
from oscilla.sources.fixtures import FEATURES, feature_log, patients, with_ctes

LOG = ("logs", "cyclefeat", "featlog")
COMPOSED = ["mean_amplitude", "peak_velocity", "mean_velocity"]
FACTORS = ["quality", "total_cycles", "num_hesitations"]


def unpivoted(table: str, ids: str) -> str:
    names = ", ".join(FEATURES)
    typed = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    return f"(SELECT {ids}, {typed} FROM {table}) UNPIVOT (value FOR feature IN ({names}))"


def healthy_z(feature: str) -> str:
    return f"({feature} - (SELECT avg({feature}) FROM h)) / (SELECT stddev_samp({feature}) FROM h)"


@query(
    "updrs_total_merge",
    with_ctes(
        *LOG,
        body=f"""
, totals AS ({ORACLES['updrs_unpivot']})
, c AS (SELECT f.patient, f.visit, f.med, f.hand, count(*) AS n_recordings, CAST(median(t.score) AS INT) AS score,
    {', '.join(f'median(f.{c}) AS {c}' for c in COMPOSED)}
  FROM featlog f JOIN totals t ON f.patient = t.patient AND f.visit = t.visit AND f.med = t.med WHERE f.record_type = 'VIDEO' GROUP BY ALL)
, h AS (SELECT * FROM c WHERE score = 0)
SELECT patient, visit, med, hand, n_recordings, score, round(mean_amplitude, 6) AS mean_amplitude,
  round(-({' + '.join(healthy_z(c) for c in COMPOSED)}) / 3, 6) AS composite_score FROM c""",
    ),
)
def updrs_total_merge(spark, sf_dir):
    totals = updrs_unpivot(spark, sf_dir).withColumnRenamed("score", "total")
    out = R.merge_totals(feature_log(spark, sf_dir), totals, COMPOSED)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_amplitude", "composite_score")]
    return out.select("patient", "visit", "med", "hand", "n_recordings", "score", *rounded)


@query(
    "score_summaries",
    _sql(
        """
SELECT feature, score, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max, round(median(value), 6) AS median FROM long GROUP BY feature, score"""
    ),
)
def score_summaries(spark, sf_dir):
    out = R.summaries(stats.long_features(feature_log(spark, sf_dir), ["score"], FEATURES), "score")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max", "median")})


@query(
    "outlier_masks",
    _sql(
        """
, v AS (SELECT feature, CASE WHEN video % 997 = 5 THEN value * 40 ELSE value END AS x FROM long)
, b AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY feature)
, f AS (SELECT v.*, x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1) AS e FROM v JOIN b USING (feature))
SELECT feature, count(*) AS n, count(*) FILTER (e) AS n_extreme, coalesce(count(*) >= 4 AND count(*) FILTER (e) > 0
    AND max(x) FILTER (NOT e) > min(x) FILTER (NOT e)
    AND max(x) - min(x) > 2 * (max(x) FILTER (NOT e) - min(x) FILTER (NOT e)), false) AS has_extremes,
  round(max(x) FILTER (NOT e), 6) AS largest_kept FROM f GROUP BY feature"""
    ),
)
def outlier_masks(spark, sf_dir):
    long = stats.long_features(feature_log(spark, sf_dir), ["video"], FEATURES)
    far = F.when(F.col("video") % 997 == 5, F.col("value") * 40).otherwise(F.col("value"))
    flagged = R.extreme_outliers(long.withColumn("value", far))
    return flagged.groupBy("feature", "has_extremes").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_extreme").alias("n_extreme"),
        F.round(F.max(F.when(~F.col("is_extreme"), F.col("value"))), 6).alias("largest_kept"),
    )


@query(
    "adjusted_features",
    with_ctes(
        *LOG,
        "patients",
        body=f"""
, j AS (SELECT featlog.*, age, gender_code FROM featlog JOIN patients USING (patient))
, l AS (SELECT video, feature, value AS y, CASE WHEN video % 19 <> 0 THEN age END AS x1, CASE WHEN gender_code = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x2
   FROM {unpivoted('j', 'video, age, gender_code')})
, m AS (SELECT feature, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12,
   covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM l WHERE x1 IS NOT NULL GROUP BY feature)
SELECT video, feature, round(y - (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * (x1 - m1)
   - (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * (x2 - m2), 5) AS adjusted FROM l JOIN m USING (feature)""",
    ),
)
def adjusted_features(spark, sf_dir):
    people = patients(spark, sf_dir).select("patient", "age", "gender_code")
    log = feature_log(spark, sf_dir).join(people, "patient")
    known = log.withColumn("age", F.when(F.col("video") % 19 != 0, F.col("age")))
    out = R.adjusted(stats.long_features(known, ["video", "age", "gender_code"], FEATURES), "value", "age", "gender_code")
    return out.select("video", "feature", F.round("adjusted", 5).alias("adjusted"))


@query(
    "angle_tests",
    with_ctes(
        *LOG,
        "patients",
        body=_ANGLE_SQL
        + f"""
, l AS (SELECT * FROM {unpivoted('al', 'angle')} WHERE angle IS NOT NULL)
, o AS (SELECT *, CASE angle WHEN 'front' THEN 0 WHEN 'angled' THEN 1 WHEN 'lateral' THEN 2 WHEN 'other' THEN 3 END AS ord FROM l)
, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS ry,
   rank() OVER (PARTITION BY feature ORDER BY ord) + (count(*) OVER (PARTITION BY feature, ord) - 1) / 2.0 AS rx FROM o)
, g AS (SELECT feature, angle, sum(ry) AS s, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY ALL)
, t AS (SELECT feature, sum(c * c * c - c) AS t FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS c FROM l GROUP BY ALL) GROUP BY ALL)
, h AS (SELECT feature, count(*) AS k, sum(c) AS n, 12.0 / (sum(c) * (sum(c) + 1)) * sum(s * s / c) - 3.0 * (sum(c) + 1) AS h0 FROM g GROUP BY feature)
, rho AS (SELECT feature, corr(rx, ry) AS rho FROM r GROUP BY feature)
SELECT feature, k AS n_groups, CAST(n AS BIGINT) AS n, round(h0 / (1 - t / (n * n * n - n)), 6) AS h, round(rho, 8) AS rho
FROM h JOIN t USING (feature) JOIN rho USING (feature)""",
    ),
)
def angle_tests(spark, sf_dir):
    df = cohort.attach_labels(feature_log(spark, sf_dir), _angles(spark, sf_dir), "patient", "angle")
    out = R.angle_tests(stats.long_features(df, ["angle"], FEATURES))
    return out.select("feature", "n_groups", "n", F.round("h", 6).alias("h"), F.round("rho", 8).alias("rho"))


@query(
    "angle_score_shares",
    with_ctes(
        *LOG,
        "patients",
        body=_ANGLE_SQL
        + """
, k AS (SELECT angle, score FROM al WHERE angle IS NOT NULL AND score IS NOT NULL)
, g AS (SELECT * FROM (SELECT angle, count(*) AS t FROM k GROUP BY angle), (SELECT DISTINCT score FROM k))
SELECT angle, score, count(k.score) AS n, round(100.0 * count(k.score) / any_value(t), 6) AS percent
FROM g LEFT JOIN k USING (angle, score) GROUP BY angle, score""",
    ),
)
def angle_score_shares(spark, sf_dir):
    df = cohort.attach_labels(feature_log(spark, sf_dir), _angles(spark, sf_dir), "patient", "angle")
    return R.score_shares(df).withColumn("percent", F.round("percent", 6))


@query(
    "factor_correlations",
    with_ctes(
        *LOG,
        body=f"""
, w AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in [*FACTORS, *FEATURES])} FROM featlog
   WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*FACTORS, *FEATURES])})
"""
        + "\nUNION ALL ".join(
            f"SELECT count(*) AS n, '{a}' AS factor, '{b}' AS feature, round(corr({a}, {b}), 7) AS r FROM w" for a in FACTORS for b in FEATURES
        ),
    ),
)
def factor_correlations(spark, sf_dir):
    out = R.factor_correlations(feature_log(spark, sf_dir), FACTORS, FEATURES)
    return out.withColumn("r", F.round("r", 7))


@query(
    "factor_trends",
    with_ctes(
        *LOG,
        body="""
, l AS (SELECT quality AS q, factor, value FROM (SELECT quality, CAST(total_cycles AS DOUBLE) AS total_cycles, CAST(num_hesitations AS DOUBLE) AS num_hesitations,
     CAST(global_velocity AS DOUBLE) AS global_velocity FROM featlog WHERE quality IS NOT NULL) UNPIVOT (value FOR factor IN (total_cycles, num_hesitations, global_velocity)))
, r AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY value) + (count(*) OVER (PARTITION BY factor, value) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY factor ORDER BY q) + (count(*) OVER (PARTITION BY factor, q) - 1) / 2.0 AS ry FROM l)
SELECT factor, count(*) AS n, round(corr(rx, ry), 8) AS rho, round(regr_slope(q, value), 8) AS slope, round(regr_intercept(q, value), 7) AS intercept
FROM r GROUP BY factor""",
    ),
)
def factor_trends(spark, sf_dir):
    out = R.factor_trends(feature_log(spark, sf_dir), ["total_cycles", "num_hesitations", "global_velocity"], "quality")
    return out.select("factor", "n", F.round("rho", 8).alias("rho"), F.round("slope", 8).alias("slope"), F.round("intercept", 7).alias("intercept"))


@query(
    "factor_by_score",
    with_ctes(
        *LOG,
        body=f"""
SELECT factor, score, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM
 (SELECT score, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FACTORS)} FROM featlog) UNPIVOT (value FOR factor IN ({', '.join(FACTORS)})) GROUP BY factor, score""",
    ),
)
def factor_by_score(spark, sf_dir):
    out = R.summaries(durable(stats.long_features(feature_log(spark, sf_dir), ["score"], FACTORS)), "score")
    return out.select(F.col("feature").alias("factor"), "score", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))
