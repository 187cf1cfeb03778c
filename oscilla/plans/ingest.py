"""Ingest and key-normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators import cohort
from oscilla.plans.registry import query
from oscilla.sources.fixtures import patients, recording_logs, table, with_ctes

# RE2 has no look-around, so the SQL consumes one neighbouring character instead.
_MED_SQL = r"regexp_extract({p}, '(?i)(^|[^A-Za-z])(On|Off)([^A-Za-z]|$)', 2)"


@query(
    "path_parse",
    with_ctes(
        "logs",
        body=r"""
SELECT video, nullif(upper(substr(m, 1, 1)) || lower(substr(m, 2)), '') AS med_from_path,
       CASE WHEN contains(video_path, '_4R') THEN 'Right' WHEN contains(video_path, '_4L') THEN 'Left'
            WHEN contains(low, '_right/') OR ends_with(low, '_right') THEN 'Right'
            WHEN contains(low, '_left/') OR ends_with(low, '_left') THEN 'Left' END AS hand_from_path,
       CASE video % 4 WHEN 0 THEN token
            WHEN 1 THEN 'TULIP_' || CASE WHEN patient % 1200 < 1000
                 THEN lpad(CAST(patient % 1200 AS VARCHAR), 3, '0') ELSE CAST(patient % 1200 AS VARCHAR) END
            WHEN 2 THEN regexp_extract(video_path, '(?i)(POM\w+)', 1) END AS ids,
       CASE video % 4 WHEN 1 THEN 1 WHEN 3 THEN NULL ELSE visit END AS path_visit,
       CASE video % 4 WHEN 0 THEN token
            WHEN 1 THEN 'TULIP_' || CASE WHEN patient % 1200 < 1000
                 THEN lpad(CAST(patient % 1200 AS VARCHAR), 3, '0') ELSE CAST(patient % 1200 AS VARCHAR) END
            WHEN 2 THEN token END AS canonical_id,
       CAST(nullif(regexp_extract(video_path, '(?i)\bPOM([1-3])[A-Za-z0-9]', 1), '') AS INT) AS token_visit
FROM (SELECT *, """
        + _MED_SQL.format(p="video_path")
        + r""" AS m, lower(replace(video_path, '\', '/')) AS low FROM logs)""",
    ),
)
def path_parse(spark, sf_dir):
    logs = recording_logs(spark, sf_dir)
    path = F.col("video_path")
    ids, visit = N.ids_and_visit_from_path(path)
    named = logs.select("video", "video_path", ids.alias("ids"), visit.alias("path_visit"))
    return named.select(
        "video",
        N.medication_from_path(path).alias("med_from_path"),
        N.hand_from_path(path).alias("hand_from_path"),
        "ids",
        "path_visit",
        N.canonical_video_id(F.col("ids")).alias("canonical_id"),
        N.visit_from_token(path).alias("token_visit"),
    )


@query(
    "path_match_keys",
    with_ctes(
        "logs",
        body=r"""
SELECT video, CASE video % 4
    WHEN 0 THEN CASE WHEN med IS NOT NULL
        THEN 'clip::v' || visit || '_' || lower(token) || '_' || lower(side) || ' clip.mp4'
        ELSE lower(side) || ' clip_cropped.mp4' END
    WHEN 1 THEN 'cam' || (video % 3) || '.mp4'
    WHEN 2 THEN 'seg::' || lower(token) || '_ps_' || visit || '_' || lower(side) || '.mp4'
    ELSE (video % 5000) || '.mp4' END AS match_key,
  CASE WHEN med IS NOT NULL AND video % 4 = 0 THEN '__med___4' || lower(substr(hand, 1, 1)) || '  clip_cropped.mp4'
       WHEN med IS NOT NULL AND video % 4 = 2 THEN 'segmented_video_' || lower(token) || '_ps_' || visit
            || '___med___4' || lower(substr(hand, 1, 1)) || '_cropped.mp4' END AS neutral_key
FROM logs""",
    ),
)
def path_match_keys(spark, sf_dir):
    return recording_logs(spark, sf_dir).select(
        "video",
        N.path_match_key(F.col("video_path")).alias("match_key"),
        N.medication_neutral_key(F.col("video_path")).alias("neutral_key"),
    )


@query(
    "norm_labels",
    r"""
SELECT o_orderkey AS video,
  CASE WHEN starts_with(m, 'on') THEN 'On' WHEN starts_with(m, 'off') THEN 'Off' END AS med,
  CASE WHEN h IN ('l', 'left', 'lhs') THEN 'Left' WHEN h IN ('r', 'right', 'rhs') THEN 'Right'
       WHEN contains(h, 'right') OR contains(h, '4r') THEN 'Right'
       WHEN contains(h, 'left') OR contains(h, '4l') THEN 'Left' END AS hand,
  CASE o_orderkey % 5 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN 7 END AS visit,
  CASE o_orderkey % 5 WHEN 0 THEN v WHEN 1 THEN v END AS score,
  CASE WHEN v IN (0, 1) THEN 'Mild' WHEN v = 2 THEN 'Moderate' WHEN v IN (3, 4) THEN 'Severe' END AS severity
FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS v,
  lower(CASE o_orderstatus WHEN 'O' THEN ' ON med' WHEN 'F' THEN 'off-state' ELSE '?' END) AS raw_m,
  ltrim(lower(CASE o_orderstatus WHEN 'O' THEN ' ON med' WHEN 'F' THEN 'off-state' ELSE '?' END)) AS m,
  CASE o_orderkey % 6 WHEN 0 THEN 'l' WHEN 1 THEN 'rhs' WHEN 2 THEN 'x_4r' WHEN 3 THEN 'left hand' WHEN 4 THEN 'both' END AS h
  FROM orders)""",
)
def norm_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    digit = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string")
    raw_med = (
        F.when(F.col("o_orderstatus") == "O", " ON med")
        .when(F.col("o_orderstatus") == "F", "off-state")
        .otherwise("?")
    )
    raw_hand = F.element_at(
        F.array(*[F.lit(x) for x in (" L", "rhs", "x_4R", "Left hand", "both", None)]),
        (key % 6 + 1).cast("int"),
    )
    raw_number = (
        F.when(key % 5 == 0, digit)
        .when(key % 5 == 1, F.concat(F.lit(" "), digit, F.lit(".0 ")))
        .when(key % 5 == 2, F.concat(F.lit("visit "), digit))
        .when(key % 5 == 3, F.lit("7.5"))
        .otherwise(F.lit(""))
    )
    return o.select(
        key.alias("video"),
        N.medication_state(raw_med).alias("med"),
        N.hand(raw_hand).alias("hand"),
        N.visit_number(raw_number).alias("visit"),
        N.integer_score(raw_number).alias("score"),
        N.severity(digit.cast("int")).alias("severity"),
    )


@query(
    "demographic_groups",
    with_ctes(
        "patients",
        body="""
SELECT CASE WHEN age < 60 THEN '<60' WHEN age < 70 THEN '60-69' ELSE '70+' END AS age_group,
       CASE gender_code WHEN 1 THEN 'Male' ELSE 'Female' END AS gender,
       CASE WHEN age < 60 THEN 'lt60' WHEN age < 70 THEN '60_69' ELSE '70plus' END AS group_label,
       count(*) AS n, round(avg(age), 6) AS mean_age
FROM patients GROUP BY ALL""",
    ),
)
def demographic_groups(spark, sf_dir):
    p = patients(spark, sf_dir).select("age", "gender_code")
    return (
        p.groupBy(
            N.age_group(F.col("age")).alias("age_group"), N.gender(F.col("gender_code")).alias("gender")
        )
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 6).alias("mean_age"))
        .withColumn("group_label", N.group_label(F.col("age_group")))
    )


@query(
    "segment_mask",
    with_ctes(
        "logs",
        body="""
SELECT count(*) AS n_all, count(*) FILTER (contains(lower(video_path), 'segmented')) AS n_segmented,
       count(*) FILTER (NOT contains(lower(video_path), 'segmented')) AS n_whole, CAST(0 AS BIGINT) AS n_both
FROM logs""",
    ),
)
def segment_mask(spark, sf_dir):
    logs = recording_logs(spark, sf_dir).select("video_path")
    name = F.col("video_path")
    return logs.agg(
        *[
            F.count_if(cohort.segment_mask(name, only, whole)).alias(alias)
            for alias, only, whole in (
                ("n_all", False, False),
                ("n_segmented", True, False),
                ("n_whole", False, True),
                ("n_both", True, True),
            )
        ]
    )


@query(
    "quality_label_filter",
    """
WITH lab AS (SELECT 'doc' || (doc_id % 300) AS k, CASE doc_id % 9 WHEN 8 THEN 5 ELSE quality + toxic + 1 END AS q FROM labels),
best AS (SELECT k, min(q) AS q FROM lab WHERE q BETWEEN 1 AND 3 GROUP BY k)
SELECT doc_id, CAST(q AS INT) AS quality_label FROM documents JOIN best ON 'doc' || (doc_id % 400) = k WHERE q <= 1""",
)
def quality_label_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("/a/Doc"), (F.col("doc_id") % 300).cast("string")).alias("video_path"),
        F.when(F.col("doc_id") % 9 == 8, 5)
        .otherwise(F.col("quality") + F.col("toxic") + 1)
        .alias("quality_label"),
    )
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/b/doc"), (F.col("doc_id") % 400).cast("string")).alias("video_path")
    )
    best = cohort.best_quality_labels(labels, "video_path", "quality_label")
    return cohort.quality_filter(docs, best, "video_path", 1).select("doc_id", "quality_label")


@query(
    "angle_alias_filter",
    with_ctes(
        "logs",
        "patients",
        body="""
, ang AS (SELECT patient, CASE segment WHEN 'AUTOMOBILE' THEN 'front' WHEN 'BUILDING' THEN 'front'
    WHEN 'MACHINERY' THEN 'lateral' WHEN 'HOUSEHOLD' THEN 'angled' ELSE NULL END AS angle FROM patients)
SELECT video, angle FROM logs JOIN ang USING (patient) WHERE angle IN ('front', 'lateral')""",
    ),
)
def angle_alias_filter(spark, sf_dir):
    p = patients(spark, sf_dir).select("patient", "segment")
    raw = (
        F.when(F.col("segment") == "AUTOMOBILE", "Front View ")
        .when(F.col("segment") == "BUILDING", "frontal")
        .when(F.col("segment") == "MACHINERY", "SIDE")
        .when(F.col("segment") == "HOUSEHOLD", "angled view")
        .otherwise(" ")
    )
    angles = p.select("patient", N.recording_angle(raw).alias("angle"))
    logs = recording_logs(spark, sf_dir).select("video", "patient")
    allowed = cohort.angle_allow_list(["Front", "lateral view"])
    return (
        cohort.attach_labels(logs, angles, "patient", "angle")
        .filter(F.col("angle").isin(allowed))
        .select("video", "angle")
    )


@query(
    "idmap_last_wins",
    with_ctes(
        "logs",
        body="""
, m AS (SELECT o_custkey % 3000 AS vid, arg_max(o_orderkey, o_orderkey) AS pat FROM orders GROUP BY 1)
SELECT video, coalesce(CAST(pat AS VARCHAR), 'POM' || patient) AS mapped, pat IS NULL AS unmapped
FROM logs LEFT JOIN m ON vid = patient""",
    ),
)
def idmap_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # id map lines in ingest order: patient, tuple text with one or two video ids
    lines = o.select(
        F.col("o_orderkey").alias("line_no"),
        F.col("o_orderkey").cast("string").alias("patient_id"),
        F.concat(
            F.lit("('POM"), (F.col("o_custkey") % 3000).cast("string"), F.lit("', \"POM"),
            (F.col("o_custkey") % 3000).cast("string"), F.lit("\")"),
        ).alias("video_ids"),
    )
    mapping = cohort.id_map(lines, "line_no", "patient_id", "video_ids")
    logs = recording_logs(spark, sf_dir).select(
        "video", F.concat(F.lit("POM"), F.col("patient").cast("string")).alias("video_id")
    )
    mapped = cohort.map_patients(logs, mapping, keep_unmatched=True)
    return mapped.select("video", F.col("patient_id").alias("mapped"), "unmapped")


@query(
    "updrs_unpivot",
    """
SELECT c_custkey AS patient, v AS visit, m AS med, CAST(s AS DOUBLE) AS score FROM (
  SELECT c_custkey, unnest([1, 1, 2, 2, 3, 3]) AS v, unnest(['Off', 'On', 'Off', 'On', 'Off', 'On']) AS m,
         unnest([CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 END, c_custkey % 41, c_custkey % 42,
                 CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 43 END, NULL, c_custkey % 44]) AS s FROM customer)
WHERE s IS NOT NULL""",
)
def updrs_unpivot(spark, sf_dir):
    key = F.col("c_custkey")
    wide = table(spark, sf_dir, "customer").select(
        key.alias("patient"),
        F.when(key % 5 != 0, key % 40).alias("UPDRS_V1_OFF"),
        (key % 41).alias("updrs_v1_on"),
        (key % 42).alias("updrs_v2_off"),
        F.when(key % 7 != 0, key % 43).alias("updrs_v2_on"),
        F.lit(None).cast("long").alias("updrs_v3_off"),
        (key % 44).alias("updrs_v3_on"),
    )
    return cohort.updrs_long(wide, "patient", "score")


@query(
    "optional_key_lookup",
    with_ctes(
        "logs",
        body="""
, s AS (SELECT DISTINCT patient, visit, med, hand, score FROM logs WHERE med IS NOT NULL)
SELECT l.video, CASE WHEN count(DISTINCT s.score) = 1 THEN min(s.score) END AS score
FROM logs l LEFT JOIN s ON s.patient = l.patient AND (l.video % 3 = 0 OR s.visit = l.visit)
  AND (l.med IS NULL OR s.med = l.med) AND (l.video % 5 = 0 OR s.hand = l.hand) GROUP BY l.video""",
    ),
)
def optional_key_lookup(spark, sf_dir):
    logs = recording_logs(spark, sf_dir)
    scores = logs.filter(F.col("med").isNotNull()).select("patient", "visit", "med", "hand", "score")
    asked = logs.select(
        "video",
        "patient",
        F.when(F.col("video") % 3 != 0, F.col("visit")).alias("visit"),
        "med",
        F.when(F.col("video") % 5 != 0, F.col("hand")).alias("hand"),
    )
    return cohort.resolve_scores(asked, scores, "patient", ["visit", "med", "hand"], "score").select(
        "video", "score"
    )
