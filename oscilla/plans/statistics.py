"""Cohort statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators import paired, stats
from oscilla.operators.cohort import attach_labels
from oscilla.operators.ordering import exact_percentiles
from oscilla.plans.registry import query
from oscilla.session import durable
from oscilla.sources.fixtures import FEATURES, feature_log, patients, recording_logs, with_ctes

_LONG_SQL = (
    ", long AS (SELECT video, score, feature, CAST(value AS DOUBLE) AS value FROM (SELECT video, score, "
    + ", ".join(FEATURES)
    + " FROM featlog) UNPIVOT (value FOR feature IN ("
    + ", ".join(FEATURES)
    + ")))"
)
_DIR_SQL = "CASE WHEN feature IN ('amplitude_cv', 'rhythm_cv', 'pause_time_ratio', 'arm_swing') THEN 1 ELSE -1 END"


def _sql(body: str) -> str:
    return with_ctes("logs", "cyclefeat", "featlog", body=_LONG_SQL + body)


def _features(spark, sf_dir):
    return stats.long_features(feature_log(spark, sf_dir), ["score"], FEATURES)


def _long(spark, sf_dir):
    """The feature table of all recordings, written once for the statistics that read it several times."""
    return durable(_features(spark, sf_dir))


_RANKS = """
, rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS ry,
         rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2.0 AS rx FROM long)"""


@query(
    "spearman_by_feature",
    _sql(_RANKS + " SELECT feature, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM rk GROUP BY feature"),
)
def spearman_by_feature(spark, sf_dir):
    out = stats.spearman(_long(spark, sf_dir), ["feature"], "score", "value", with_p=False)
    return out.select("feature", "n", F.round("rho", 8).alias("rho"))


@query(
    "kruskal_h",
    _sql(
        _RANKS
        + """
, g AS (SELECT feature, score, sum(ry) AS r, count(*) AS n FROM rk GROUP BY ALL)
, t AS (SELECT feature, sum(c * c * c - c) AS t FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS c FROM long GROUP BY ALL) GROUP BY ALL)
, h AS (SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, 12.0 / (sum(n) * (CAST(sum(n) AS DOUBLE) + 1)) * sum(r * r / n) - 3.0 * (sum(n) + 1) AS h0 FROM g GROUP BY feature)
, c AS (SELECT feature, k, n, h0 / (1 - t / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM h JOIN t USING (feature))
SELECT feature, k, n, round(h, 6) AS h, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM c"""
    ),
)
def kruskal_h(spark, sf_dir):
    out = stats.kruskal(_features(spark, sf_dir), ["feature"], "score", "value")
    return out.select("feature", F.col("n_groups").alias("k"), "n", F.round("h", 6).alias("h"), F.round("p", 6).alias("p"))


_MOMENTS = ", m AS (SELECT feature, score, count(*) AS n, avg(value) AS mu, var_samp(value) AS v FROM long GROUP BY ALL)"


@query(
    "cohens_d",
    _sql(
        _MOMENTS
        + """
, a AS (SELECT feature, score AS low, lead(score) OVER w AS high, n AS n1, lead(n) OVER w AS n2, mu AS m1, lead(mu) OVER w AS m2,
        v AS v1, lead(v) OVER w AS v2, 'adjacent' AS contrast FROM m WINDOW w AS (PARTITION BY feature ORDER BY score))
, e AS (SELECT z.feature, 0 AS low, t.score AS high, z.n AS n1, t.n AS n2, z.mu AS m1, t.mu AS m2, z.v AS v1, t.v AS v2, 'extreme' AS contrast
        FROM m z JOIN m t ON z.feature = t.feature AND z.score = 0 AND t.score = (SELECT max(score) FROM m x WHERE x.feature = z.feature))
SELECT feature, CAST(low AS INT) AS low, CAST(high AS INT) AS high, contrast, round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 8) AS d,
  CASE WHEN contrast = 'extreme' THEN round((m2 - m1) / sqrt(v1), 8) END AS glass_delta,
  CASE WHEN abs((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))) < 0.2 THEN 'negligible' ELSE 'small' END AS label
FROM (SELECT * FROM a WHERE high IS NOT NULL UNION ALL BY NAME SELECT * FROM e)"""
    ),
)
def cohens_d(spark, sf_dir):
    out = stats.effect_sizes(_long(spark, sf_dir), ["feature"], "score", "value")
    return out.withColumns({c: F.round(c, 8) for c in ("d", "glass_delta")})


@query(
    "direction_check",
    _sql(
        _MOMENTS
        + f"""
, e AS (SELECT z.feature, t.mu - z.mu AS diff FROM m z JOIN m t ON z.feature = t.feature AND z.score = 0 AND t.score = 4)
SELECT feature, {_DIR_SQL} AS expected, CAST(sign(diff) AS INT) AS observed,
  CASE WHEN sign(diff) = {_DIR_SQL} THEN 'correct' WHEN diff = 0 THEN 'none' ELSE 'wrong' END AS direction FROM e"""
    ),
)
def direction_check(spark, sf_dir):
    return stats.direction_check(stats.effect_sizes(_long(spark, sf_dir), ["feature"], "score", "value"))


_MEDS = ", md AS (SELECT feature, score, median(value) AS med, count(*) AS n, avg(value) AS mu, var_samp(value) AS v FROM long GROUP BY ALL)"
_TAU = """
, tau AS (SELECT a.feature, sum(sign(b.med - a.med)) / nullif(sqrt(10.0 * sum(abs(sign(b.med - a.med)))), 0) AS tau
          FROM md a JOIN md b ON a.feature = b.feature AND a.score < b.score GROUP BY a.feature)"""
_SPREAD = """
, w AS (SELECT feature, sqrt(sum((n - 1) * v) / (sum(n) - count(*))) AS ws, stddev_samp(med) AS bs FROM md GROUP BY feature)
, sp AS (SELECT feature, least(2.0, ws / (SELECT stddev_samp(value) FROM long l WHERE l.feature = w.feature)) AS dr, CASE WHEN bs >= 1e-12 THEN least(5.0, ws / bs) END AS sr FROM w)"""


@query("kendall_group_medians", _sql(_MEDS + _TAU + " SELECT feature, 5 AS n_groups, round(tau, 8) AS tau FROM tau"))
def kendall_group_medians(spark, sf_dir):
    out = stats.kendall_on_medians(_long(spark, sf_dir), ["feature"], "score", "value")
    return out.withColumn("tau", F.round("tau", 8))


@query(
    "dispersion_spread",
    _sql(_MEDS + _SPREAD + " SELECT feature, round(dr, 7) AS dispersion_ratio, round(sr, 7) AS spread_ratio FROM sp"),
)
def dispersion_spread(spark, sf_dir):
    out = stats.dispersion_ratios(_long(spark, sf_dir), ["feature"], "score", "value")
    return out.withColumns({c: F.round(c, 7) for c in ("dispersion_ratio", "spread_ratio")})


@query(
    "alignment_composite",
    _sql(
        _RANKS
        + _MEDS
        + _TAU
        + _SPREAD
        + f"""
, r AS (SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY feature)
SELECT feature, n, round(rho, 7) AS rho, round(tau, 7) AS tau, round(dr, 7) AS dispersion_ratio, round(sr, 7) AS spread_ratio,
  {_DIR_SQL} AS direction, round(rho * {_DIR_SQL} + 0.3 * coalesce(tau * {_DIR_SQL}, 0) - 0.2 * coalesce(dr, 0) - 0.2 * coalesce(sr, 0), 6) AS contribution
FROM r JOIN tau USING (feature) JOIN sp USING (feature)"""
    ),
)
def alignment_composite(spark, sf_dir):
    out = stats.alignment(_features(spark, sf_dir), "score", "value")
    return out.withColumns(
        {
            **{c: F.round(c, 7) for c in ("rho", "tau", "dispersion_ratio", "spread_ratio")},
            "contribution": F.round("contribution", 6),
        }
    )


@query(
    "mwu_u",
    _sql(
        """
, z AS (SELECT feature, value FROM long WHERE score = 0)
, p AS (SELECT z.feature, s.score, value FROM z JOIN (SELECT DISTINCT score FROM long WHERE score > 0) s ON true
        UNION ALL SELECT feature, score, value FROM long WHERE score > 0)
, tagged AS (SELECT z.feature, s.score, value, 1 AS ref FROM z JOIN (SELECT DISTINCT score FROM long WHERE score > 0) s ON true
        UNION ALL SELECT feature, score, value, 0 FROM long WHERE score > 0)
, rk AS (SELECT *, rank() OVER (PARTITION BY feature, score ORDER BY value) + (count(*) OVER (PARTITION BY feature, score, value) - 1) / 2.0 AS r,
         CAST(count(*) OVER (PARTITION BY feature, score, value) AS DOUBLE) AS t FROM tagged)
SELECT feature, CAST(0 AS INT) AS ref, score, CAST(sum(ref) AS BIGINT) AS n1, CAST(sum(1 - ref) AS BIGINT) AS n2,
  round(sum(r) FILTER (ref = 1) - sum(ref) * (sum(ref) + 1) / 2.0, 1) AS u, round(sum(t * t - 1), 1) AS tie_term
FROM rk GROUP BY feature, score"""
    ),
)
def mwu_u(spark, sf_dir):
    out = stats.mann_whitney_vs_lowest(_long(spark, sf_dir), ["feature"], "score", "value")
    return out.withColumns({c: F.round(c, 1) for c in ("u", "tie_term")})


@query("posthoc_tests")
def posthoc_tests(spark, sf_dir):
    return stats.posthoc(_long(spark, sf_dir), ["feature"], "score", "value")


@query(
    "ancova_f",
    with_ctes(
        "logs",
        "patients",
        "cyclefeat",
        "featlog",
        body="""
, d AS (SELECT score, mean_amplitude AS y, age AS x, CASE WHEN gender_code = 2 THEN 1.0 ELSE 0.0 END AS z FROM featlog JOIN patients USING (patient) WHERE mean_amplitude IS NOT NULL)
, c AS (SELECT y - avg(y) OVER () AS ty, x - avg(x) OVER () AS tx, z - avg(z) OVER () AS tz, y - avg(y) OVER (PARTITION BY score) AS wy,
   x - avg(x) OVER (PARTITION BY score) AS wx, z - avg(z) OVER (PARTITION BY score) AS wz, score FROM d)
, s AS (SELECT count(*) AS n, count(DISTINCT score) AS k, sum(ty * ty) AS a, sum(tx * tx) AS b, sum(tz * tz) AS c, sum(tx * tz) AS e, sum(ty * tx) AS f, sum(ty * tz) AS g,
   sum(wy * wy) AS wa, sum(wx * wx) AS wb, sum(wz * wz) AS wc, sum(wx * wz) AS we, sum(wy * wx) AS wf, sum(wy * wz) AS wg FROM c)
, r AS (SELECT n, k, a - (f * c - g * e) / (b * c - e * e) * f - (g * b - f * e) / (b * c - e * e) * g AS rt,
   wa - (wf * wc - wg * we) / (wb * wc - we * we) * wf - (wg * wb - wf * we) / (wb * wc - we * we) * wg AS rw FROM s)
SELECT 'mean_amplitude' AS feature, n, round(((rt - rw) / (k - 1)) / (rw / (n - k - 2)), 5) AS f, k - 1 AS d1, n - k - 2 AS d2 FROM r""",
    ),
)
def ancova_f(spark, sf_dir):
    p = patients(spark, sf_dir).select(
        "patient", "age", F.when(F.col("gender_code") == 2, 1.0).otherwise(0.0).alias("female")
    )
    df = feature_log(spark, sf_dir).join(p, "patient").withColumn("feature", F.lit("mean_amplitude"))
    out = stats.ancova(df, ["feature"], "score", "mean_amplitude", ["age", "female"])
    return out.select("feature", "n", F.round("f", 5).alias("f"), "d1", "d2")


_COMPLETE = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
_UPPER = [(x, y) for i, x in enumerate(FEATURES) for y in FEATURES[i:]]


@query(
    "corr_matrix",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=f", c AS (SELECT {', '.join(FEATURES)} FROM featlog WHERE {_COMPLETE})"
        + " UNION ALL ".join(f" SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 7) AS r, count(*) AS n FROM c" for x, y in _UPPER),
    ),
)
def corr_matrix(spark, sf_dir):
    out = stats.correlation_matrix(feature_log(spark, sf_dir), FEATURES)
    return out.withColumn("r", F.round("r", 7))


@query(
    "spearman_matrix",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=", c AS (SELECT "
        + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in FEATURES)
        + f" FROM featlog WHERE {_COMPLETE})"
        + " UNION ALL ".join(f" SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 7) AS r, count(*) AS n FROM c" for x, y in _UPPER),
    ),
)
def spearman_matrix(spark, sf_dir):
    out = stats.correlation_matrix(feature_log(spark, sf_dir), FEATURES, ranks=True)
    return out.withColumn("r", F.round("r", 7))


@query(
    "distribution_summary",
    with_ctes(
        "logs",
        body="""
SELECT count(quality) AS n, round(avg(quality), 8) AS mean, round(stddev_samp(quality), 8) AS std, round(min(quality), 8) AS min,
  round(max(quality), 8) AS max, round(quantile_cont(quality, 0.1), 8) AS p10, round(quantile_cont(quality, 0.25), 8) AS p25,
  round(quantile_cont(quality, 0.5), 8) AS p50, round(quantile_cont(quality, 0.75), 8) AS p75, round(quantile_cont(quality, 0.9), 8) AS p90,
  count(*) FILTER (quality >= 0.6) AS n_pass FROM logs""",
    ),
)
def distribution_summary(spark, sf_dir):
    q = recording_logs(spark, sf_dir).select("quality").filter(F.col("quality").isNotNull())
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    row = exact_percentiles(q, [], "quality", points)
    base = q.agg(
        F.count("quality").alias("n"),
        F.avg("quality").alias("mean"),
        F.stddev_samp("quality").alias("std"),
        F.min("quality").alias("min"),
        F.max("quality").alias("max"),
        F.count_if(F.col("quality") >= 0.6).alias("n_pass"),
    ).withColumn("_p", row.select(F.struct(*points)).scalar())
    out = base.select("*", "_p.*").drop("_p")
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "std", "min", "max", *points)})


@query(
    "bubble_props",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body="""
SELECT score, num_hesitations AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY score), 8) AS share
FROM featlog WHERE num_hesitations IS NOT NULL GROUP BY score, num_hesitations""",
    ),
)
def bubble_props(spark, sf_dir):
    df = feature_log(spark, sf_dir).filter(F.col("num_hesitations").isNotNull())
    cells = df.groupBy("score", F.col("num_hesitations").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("score").agg(F.sum("n").alias("_t"))
    return cells.join(totals, "score").select(
        "score", "value", "n", F.round(F.col("n") / F.col("_t"), 8).alias("share")
    )


def _angles(spark, sf_dir):
    p = patients(spark, sf_dir)
    raw = (
        F.when(F.col("segment") == "AUTOMOBILE", "frontal")
        .when(F.col("segment") == "MACHINERY", "side")
        .when(F.col("segment") == "HOUSEHOLD", "angled view")
        .otherwise("other")
    )
    return p.select("patient", N.recording_angle(raw).alias("angle"))


_ANGLE_SQL = """, ang AS (SELECT patient, CASE segment WHEN 'AUTOMOBILE' THEN 'front' WHEN 'MACHINERY' THEN 'lateral'
  WHEN 'HOUSEHOLD' THEN 'angled' ELSE 'other' END AS angle FROM patients)
, al AS (SELECT featlog.*, angle FROM featlog LEFT JOIN ang USING (patient))"""


@query(
    "angle_score_cube",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        "patients",
        body=_ANGLE_SQL
        + """
SELECT coalesce(angle, 'All') AS angle, coalesce(CAST(score AS VARCHAR), 'All') AS score, count(*) AS n
FROM al WHERE angle IS NOT NULL AND score IS NOT NULL GROUP BY CUBE (angle, score)""",
    ),
)
def angle_score_cube(spark, sf_dir):
    df = attach_labels(feature_log(spark, sf_dir), _angles(spark, sf_dir), "patient", "angle")
    both = df.filter(F.col("angle").isNotNull() & F.col("score").isNotNull())
    return both.cube("angle", "score").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("angle", F.lit("All")).alias("angle"),
        F.coalesce(F.col("score").cast("string"), F.lit("All")).alias("score"),
        "n",
    )


@query(
    "angle_report",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        "patients",
        body=_ANGLE_SQL
        + """
, l AS (SELECT angle, feature, value FROM (SELECT angle, """ + ", ".join(FEATURES) + """ FROM al) UNPIVOT (value FOR feature IN (""" + ", ".join(FEATURES) + """)))
, o AS (SELECT *, CASE angle WHEN 'front' THEN 0 WHEN 'angled' THEN 1 WHEN 'lateral' THEN 2 WHEN 'other' THEN 3 END AS ord FROM l WHERE angle IS NOT NULL)
, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS ry,
   rank() OVER (PARTITION BY feature ORDER BY ord) + (count(*) OVER (PARTITION BY feature, ord) - 1) / 2.0 AS rx FROM o)
, rho AS (SELECT feature, corr(rx, ry) AS rho FROM r GROUP BY feature)
SELECT feature, angle, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std,
  round(any_value(rho), 8) AS rho FROM o JOIN rho USING (feature) GROUP BY feature, angle""",
    ),
)
def angle_report(spark, sf_dir):
    df = attach_labels(feature_log(spark, sf_dir), _angles(spark, sf_dir), "patient", "angle")
    long = stats.long_features(df, ["angle"], FEATURES)
    ordinals = F.create_map(*[F.lit(x) for pair in N.ANGLE_ORDINALS.items() for x in pair])
    profiled = stats.profile(long, ["feature"], "angle", "value", F.try_element_at(ordinals, F.col("angle")))
    rho = stats.spearman_of(profiled, ["feature"], with_p=False).select("feature", "rho")
    return profiled.join(rho, "feature").select(
        "feature",
        "angle",
        "n",
        F.round("mean", 6).alias("mean"),
        F.round(F.sqrt("var"), 6).alias("std"),
        F.round("med", 6).alias("median"),
        F.round("rho", 8).alias("rho"),
    )


@query(
    "sq_high_low",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body="""
, q AS (SELECT *, quality >= (SELECT median(quality) FROM featlog) AS high FROM featlog WHERE quality IS NOT NULL)
, l AS (SELECT high, factor, value FROM (SELECT high, mean_amplitude, global_velocity, arm_swing FROM q) UNPIVOT (value FOR factor IN (mean_amplitude, global_velocity, arm_swing)))
SELECT factor, round(median(value) FILTER (high), 8) AS high_median, round(median(value) FILTER (NOT high), 8) AS low_median,
  round(median(value) FILTER (high) / median(value) FILTER (NOT high), 7) AS ratio FROM l GROUP BY factor""",
    ),
)
def sq_high_low(spark, sf_dir):
    factors = ["mean_amplitude", "global_velocity", "arm_swing"]
    log = feature_log(spark, sf_dir).select("quality", *factors)
    df = durable(log.filter(F.col("quality").isNotNull()))
    med = exact_percentiles(df.select("quality"), [], "quality", {"m": 0.5}).scalar()
    split = df.withColumn("high", F.col("quality") >= med)
    long = stats.long_features(split, ["high"], factors)
    meds = exact_percentiles(long, ["feature", "high"], "value", {"m": 0.5})
    wide = meds.groupBy(F.col("feature").alias("factor")).agg(
        F.max(F.when(F.col("high"), F.col("m"))).alias("high_median"),
        F.max(F.when(~F.col("high"), F.col("m"))).alias("low_median"),
    )
    ratio = F.when(F.abs("low_median") > 1e-9, F.col("high_median") / F.nullif(F.col("low_median"), F.lit(0.0)))
    return wide.select(
        "factor",
        F.round("high_median", 8).alias("high_median"),
        F.round("low_median", 8).alias("low_median"),
        F.round(ratio, 7).alias("ratio"),
    )


@query(
    "cv_cycle_check",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body="""
, r AS (SELECT rank() OVER (ORDER BY total_cycles) + (count(*) OVER (PARTITION BY total_cycles) - 1) / 2.0 AS rx,
   rank() OVER (ORDER BY amplitude_cv) + (count(*) OVER (PARTITION BY amplitude_cv) - 1) / 2.0 AS ry FROM featlog WHERE amplitude_cv IS NOT NULL)
SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho, corr(rx, ry) < -0.15 AS inflated FROM r""",
    ),
)
def cv_cycle_check(spark, sf_dir):
    df = durable(feature_log(spark, sf_dir).select("total_cycles", "amplitude_cv"))
    out = stats.spearman(df, [], "total_cycles", "amplitude_cv")
    inflated = (F.col("n") >= 10) & (F.col("p") < 0.05) & (F.col("rho") < -0.15)
    return out.select("n", F.round("rho", 8).alias("rho"), inflated.alias("inflated"))


# longitudinal and paired reports

LONG_KEYS = ["patient", "med", "hand"]


@query(
    "visit_fill",
    with_ctes(
        "logs",
        body="""
, v AS (SELECT video, CASE WHEN video % 3 = 0 THEN visit END AS own, CASE WHEN video % 3 = 1 THEN visit END AS by_id,
   CASE WHEN video % 4 = 0 THEN visit END AS by_path FROM logs)
SELECT coalesce(own, by_id, by_path) AS visit, count(*) AS n, count(*) FILTER (coalesce(own, by_id, by_path) <> by_path) AS n_path_conflicts FROM v GROUP BY 1""",
    ),
)
def visit_fill(spark, sf_dir):
    logs = recording_logs(spark, sf_dir)
    key, visit = F.col("video"), F.col("visit")
    filled = paired.fill_visit(
        logs,
        F.when(key % 3 == 0, visit),
        F.when(key % 3 == 1, F.concat(F.lit("POM"), visit.cast("string"), F.lit("VD1"))),
        F.col("video_path"),
    )
    return filled.groupBy("visit").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("path_conflict").alias("n_path_conflicts")
    )


_LONGI_SQL = """
, bad AS (SELECT DISTINCT patient, med, hand FROM (SELECT patient, med, hand, visit FROM featlog GROUP BY ALL HAVING count(DISTINCT video) > 1))
, ok AS (SELECT * FROM featlog f WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.patient IS NOT DISTINCT FROM f.patient
   AND b.med IS NOT DISTINCT FROM f.med AND b.hand IS NOT DISTINCT FROM f.hand))
, wide AS (SELECT patient, med, hand, avg(mean_amplitude) FILTER (visit = 1) AS v1, avg(mean_amplitude) FILTER (visit = 2) AS v2,
   avg(mean_amplitude) FILTER (visit = 3) AS v3 FROM ok WHERE med IS NOT NULL GROUP BY ALL)"""


@query(
    "longitudinal_exclusion",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_LONGI_SQL + " SELECT visit, count(*) AS n_rows, (SELECT count(*) FROM bad) AS n_violating FROM ok GROUP BY visit",
    ),
)
def longitudinal_exclusion(spark, sf_dir):
    kept, bad = paired.one_video_per_visit(feature_log(spark, sf_dir), LONG_KEYS, "visit", "video")
    n_bad = bad.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.groupBy("visit").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_violating", n_bad)


def _visit_wide(spark, sf_dir, feature="mean_amplitude"):
    log = durable(feature_log(spark, sf_dir).select("video", *LONG_KEYS, "visit", feature))
    kept, _ = paired.one_video_per_visit(log, LONG_KEYS, "visit", "video")
    return paired.visit_wide(kept, LONG_KEYS, "visit", feature)


@query(
    "visit_pivot_deltas",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_LONGI_SQL
        + """
SELECT patient, med, hand, round(v1, 6) AS v1, round(v2, 6) AS v2, round(v3, 6) AS v3, round(v2 - v1, 6) AS d12, round(v3 - v2, 6) AS d23,
  round(v3 - v1, 6) AS d13, round(coalesce((v3 - v1) / 2, v2 - v1, v3 - v2), 6) AS slope FROM wide""",
    ),
)
def visit_pivot_deltas(spark, sf_dir):
    wide = _visit_wide(spark, sf_dir)
    return wide.withColumns({c: F.round(c, 6) for c in ("v1", "v2", "v3", "d12", "d23", "d13", "slope")})


@query(
    "friedman_stat",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_LONGI_SQL
        + """
, t AS (SELECT row_number() OVER () AS id, v1, v2, v3 FROM wide WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL)
, u AS (SELECT id, j, v FROM t UNPIVOT (v FOR j IN (v1, v2, v3)))
, r AS (SELECT id, j, rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2.0 AS r,
   count(*) OVER (PARTITION BY id, v) AS t FROM u)
, s AS (SELECT sum(x * x) AS ssq FROM (SELECT j, sum(r) AS x FROM r GROUP BY j))
, c AS (SELECT count(DISTINCT id) AS n, sum(t * t - 1) AS tie FROM r)
, q AS (SELECT n, (12.0 / (3.0 * n * 4) * ssq - 3.0 * n * 4) / (1 - tie / (n * 3.0 * 8)) AS chi2 FROM s, c)
SELECT n, round(chi2, 7) AS chi2, round(exp(-chi2 / 2), 7) AS p FROM q""",
    ),
)
def friedman_stat(spark, sf_dir):
    out = stats.friedman(_visit_wide(spark, sf_dir), [], ["v1", "v2", "v3"])
    return out.select("n", F.round("chi2", 7).alias("chi2"), F.round("p", 7).alias("p"))


@query(
    "wilcoxon_w",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_LONGI_SQL
        + """
, d AS (SELECT v2 - v1 AS d FROM wide WHERE v2 - v1 IS NOT NULL)
, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
SELECT count(*) AS n, (SELECT count(*) FROM d) AS n_pairs, round(coalesce(sum(r) FILTER (d > 0), 0), 1) AS w_plus, round(coalesce(sum(r) FILTER (d < 0), 0), 1) AS w_minus FROM r""",
    ),
)
def wilcoxon_w(spark, sf_dir):
    out = stats.wilcoxon(_visit_wide(spark, sf_dir), [], "d12")
    return out.select("n", "n_pairs", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"))


@query(
    "longitudinal_summary",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_LONGI_SQL
        + """ SELECT count(v1) AS n_visit1, count(v2) AS n_visit2, count(v3) AS n_visit3, count(v2 - v1) AS n_pairs_12, count(v3 - v2) AS n_pairs_23, count(v3 - v1) AS n_pairs_13,
  count(v1 + v2 + v3) AS n_triplets, round(avg(coalesce((v3 - v1) / 2, v2 - v1, v3 - v2)), 7) AS slope_mean, round(avg(v2 - v1), 7) AS delta_mean_12,
  round(median(v2 - v1), 7) AS delta_median_12, round(stddev_samp(v2 - v1), 7) AS delta_std_12, round(avg(v3 - v1) / stddev_samp(v3 - v1), 7) AS effect_size_13 FROM wide""",
    ),
)
def longitudinal_summary(spark, sf_dir):
    wide = durable(_visit_wide(spark, sf_dir).withColumn("feature", F.lit("mean_amplitude")))
    out = paired.longitudinal_summary(wide, ["feature"])
    rounded = ("slope_mean", "delta_mean_12", "delta_median_12", "delta_std_12", "effect_size_13")
    counts = [c for c in out.columns if c.startswith("n_")]
    return out.select(*counts, *[F.round(c, 7).alias(c) for c in rounded])


@query("longitudinal_report")
def longitudinal_report(spark, sf_dir):
    log = durable(feature_log(spark, sf_dir).select("video", *LONG_KEYS, "visit", *FEATURES))
    kept, _ = paired.one_video_per_visit(log, LONG_KEYS, "visit", "video")
    long = stats.long_features(kept, [*LONG_KEYS, "visit"], FEATURES)
    wide = durable(paired.visit_wide(long, LONG_KEYS, "visit", "value", extra=["feature"]))
    return paired.longitudinal_summary(wide, ["feature"])


PAIR_KEYS = ["pair_key", "patient", "visit", "hand"]


def _pairs(spark, sf_dir, values=("mean_amplitude", "score")):
    df = feature_log(spark, sf_dir).withColumn("pair_key", N.medication_neutral_key(F.col("video_path")))
    return paired.medication_pairs(df, PAIR_KEYS, "med", "video", list(values))


_PAIR_SQL = """
, k AS (SELECT *, video % 4 AS kind FROM featlog WHERE med IS NOT NULL AND video % 4 IN (0, 2))
, g AS (SELECT kind, patient, visit, hand, count(DISTINCT video) FILTER (med = 'Off') AS n_off, count(DISTINCT video) FILTER (med = 'On') AS n_on,
   min(video) FILTER (med = 'Off') AS off_video, min(video) FILTER (med = 'On') AS on_video,
   avg(mean_amplitude) FILTER (med = 'Off') AS a_off, avg(mean_amplitude) FILTER (med = 'On') AS a_on,
   avg(score) FILTER (med = 'Off') AS s_off, avg(score) FILTER (med = 'On') AS s_on FROM k GROUP BY ALL)"""


@query(
    "med_pairs",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_PAIR_SQL
        + " SELECT patient, visit, hand, off_video, on_video, round(a_on - a_off, 6) AS mean_amplitude_delta, round(s_on - s_off, 4) AS score_delta FROM g WHERE n_off = 1 AND n_on = 1",
    ),
)
def med_pairs(spark, sf_dir):
    pairs, _ = _pairs(spark, sf_dir)
    return pairs.select(
        "patient", "visit", "hand", "off_video", "on_video",
        F.round("mean_amplitude_delta", 6).alias("mean_amplitude_delta"),
        F.round("score_delta", 4).alias("score_delta"),
    )


@query(
    "med_pair_counters",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_PAIR_SQL
        + """ SELECT count(*) AS n_keys, count(*) FILTER (n_off = 1 AND n_on = 1) AS n_mapped, count(*) FILTER (n_off > 0 AND n_on = 0) AS n_off_only,
  count(*) FILTER (n_on > 0 AND n_off = 0) AS n_on_only, count(*) FILTER (n_off > 1 OR n_on > 1) AS n_several FROM g""",
    ),
)
def med_pair_counters(spark, sf_dir):
    return _pairs(spark, sf_dir)[1]


@query(
    "paired_t",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_PAIR_SQL
        + """, d AS (SELECT a_on - a_off AS d FROM g WHERE n_off = 1 AND n_on = 1 AND a_on - a_off IS NOT NULL)
SELECT count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 7) AS t FROM d""",
    ),
)
def paired_t(spark, sf_dir):
    pairs, _ = _pairs(spark, sf_dir)
    return stats.paired_t(pairs, [], "mean_amplitude_delta").select("n", F.round("t", 7).alias("t"))


_MED_LONG = """, d AS (SELECT 'mean_amplitude' AS feature, a_off AS off, a_on AS on_, a_on - a_off AS d FROM g WHERE n_off = 1 AND n_on = 1 AND a_on - a_off IS NOT NULL
 UNION ALL SELECT 'score', s_off, s_on, s_on - s_off FROM g WHERE n_off = 1 AND n_on = 1 AND s_on - s_off IS NOT NULL)"""


@query(
    "medication_summary",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_PAIR_SQL
        + _MED_LONG
        + """ SELECT feature, round(avg(off), 7) AS off_mean, round(avg(on_), 7) AS on_mean, count(*) AS n, round(avg(d), 7) AS delta_mean, round(stddev_samp(d), 7) AS delta_std,
  round(median(d), 7) AS delta_median, round(avg(d) / nullif(stddev_samp(d), 0), 7) AS effect_size FROM d GROUP BY feature""",
    ),
)
def medication_summary(spark, sf_dir):
    pairs, _ = _pairs(spark, sf_dir)
    out = paired.medication_summary(durable(pairs), ["mean_amplitude", "score"])
    kept = out.drop("wilcoxon_p", "ttest_rel_p")
    return kept.withColumns({c: F.round(c, 7) for c in kept.columns if c not in ("feature", "n")})


@query("medication_report")
def medication_report(spark, sf_dir):
    pairs, _ = _pairs(spark, sf_dir, FEATURES)
    return paired.medication_summary(durable(pairs), FEATURES)


@query(
    "score_response",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_PAIR_SQL
        + """, d AS (SELECT a_on - a_off AS d, s_on - s_off AS s FROM g WHERE n_off = 1 AND n_on = 1 AND a_on - a_off IS NOT NULL AND s_on - s_off IS NOT NULL)
, r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS b FROM d)
SELECT 'mean_amplitude' AS feature, count(*) AS n, round(corr(a, b), 7) AS rho FROM r HAVING count(*) >= 5""",
    ),
)
def score_response(spark, sf_dir):
    pairs, _ = _pairs(spark, sf_dir)
    out = paired.score_response(durable(pairs), ["mean_amplitude"], "score")
    return out.select("feature", "n", F.round("rho", 7).alias("rho"))


@query(
    "subgroup_deltas",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        "patients",
        body=_LONGI_SQL
        + """, d AS (SELECT v2 - v1 AS d, CASE WHEN age < 60 THEN '<60' WHEN age < 70 THEN '60-69' ELSE '70+' END AS ag,
  CASE gender_code WHEN 1 THEN 'Male' ELSE 'Female' END AS ge FROM wide JOIN patients USING (patient) WHERE v2 - v1 IS NOT NULL)
, l AS (SELECT 'age_group' AS grouping, ag AS label, d FROM d UNION ALL SELECT 'gender', ge, d FROM d)
SELECT grouping, label, count(*) AS n, round(avg(d), 6) AS delta_mean, round(median(d), 6) AS delta_median, round(stddev_samp(d), 6) AS delta_std,
  round(avg(d) / stddev_samp(d), 6) AS effect_size FROM l GROUP BY ALL""",
    ),
)
def subgroup_deltas(spark, sf_dir):
    p = patients(spark, sf_dir).select(
        "patient", N.age_group(F.col("age")).alias("age_group"), N.gender(F.col("gender_code")).alias("gender")
    )
    wide = durable(_visit_wide(spark, sf_dir).join(p, "patient").select("age_group", "gender", "d12"))
    out = paired.subgroup_deltas(wide, ["age_group", "gender"], "d12")
    return out.withColumns(
        {c: F.round(c, 6) for c in ("delta_mean", "delta_median", "delta_std", "effect_size")}
    )
