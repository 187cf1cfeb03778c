"""Queries that write a table in a file format and read it back, and queries of the small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oscilla.functions import naming
from oscilla.functions import normalize as N
from oscilla.operators import geometry as G
from oscilla.operators import jobs
from oscilla.operators import kinematics as K
from oscilla.operators import sequence as S
from oscilla.plans.ingest import updrs_unpivot
from oscilla.plans.registry import ORACLES, query
from oscilla.plans.signals import _ALT_SQL, FPS, KEYS, W, _raw_extrema, sliced
from oscilla.session import durable, shared_folder
from oscilla.sources import readers, sinks
from oscilla.sources.fixtures import cycle_features, frames, patients, recording_logs, table, with_ctes

RATERS = ["r1", "r2", "r3"]


def fresh(spark, suffix: str = "") -> str:
    return f"{shared_folder(spark)}/oscilla-{uuid.uuid4().hex}{suffix}"


def written(df, sep: str = ",", header: bool = True) -> str:
    path = fresh(df.sparkSession)
    df.write.option("header", header).option("sep", sep).csv(path)
    return path


@query(
    "scores_file",
    with_ctes(
        "logs",
        body="""
SELECT video, 'P' || patient AS ids, visit, med AS medication_state, hand, CASE WHEN video % 6 <> 1 AND video % 10 <> 3 THEN score END AS score_clean FROM logs""",
    ),
)
def scores_file(spark, sf_dir):
    video = F.col("video")
    text = F.when(video % 6 == 1, "2.5").when(video % 10 != 3, F.concat(F.lit(" "), F.col("score"), F.lit(".0")))
    rows = recording_logs(spark, sf_dir).select(
        "video",
        F.concat(F.lit("P"), F.col("patient"), F.lit(" ")).alias("ids"),
        F.concat(F.lit("Visit "), F.col("visit")).alias("visit"),
        F.upper("med").alias("medication_state"),
        F.lower("hand").alias("hand"),
        text.alias("score"),
    )
    out = readers.read_clinical_scores(spark, written(rows, ";"), "score")
    keyed = out.withColumns({"video": F.col("video").cast("long"), "ids": F.trim("ids")})
    return keyed.select("video", "ids", "visit", "medication_state", "hand", "score_clean")


@query("video_list_file", with_ctes("logs", body=" SELECT video_path, CASE WHEN video % 3 <> 0 THEN visit END AS visit FROM logs"))
def video_list_file(spark, sf_dir):
    logs = recording_logs(spark, sf_dir)
    rows = logs.select("video_path", F.when(F.col("video") % 3 != 0, F.col("visit")).alias("visit"))
    return readers.read_video_list(spark, written(rows))


@query(
    "demographics_file",
    "SELECT 'P' || c_custkey AS ids, CASE WHEN c_custkey % 9 <> 0 THEN CAST(20 + c_custkey % 70 AS DOUBLE) END AS age, CAST(c_custkey % 2 + 1 AS DOUBLE) AS Gender FROM customer",
)
def demographics_file(spark, sf_dir):
    """Of the rows of a subject the first counts: later parts of the file repeat every third one with another age."""
    people = patients(spark, sf_dir)
    known = F.when(F.col("patient") % 9 == 0, "unknown").otherwise(F.col("age").cast("string"))
    first = people.select(F.concat(F.lit("P"), F.col("patient")).alias("Subject"), known.alias("age"), F.col("gender_code").alias("Gender"))
    again = first.filter(F.col("Gender") == 2).withColumn("age", F.lit("99"))
    return readers.read_age_gender(spark, written(first.unionByName(again)))


@query(
    "angle_labels_file",
    """
SELECT lower('Clip' || c_custkey) AS angle_key, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'front' WHEN 'MACHINERY' THEN 'lateral' ELSE 'other' END AS recording_angle
FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def angle_labels_file(spark, sf_dir):
    angle = F.when(F.col("segment") == "AUTOMOBILE", "Frontal ").when(F.col("segment") == "MACHINERY", "side").when(F.col("segment") != "BUILDING", "OTHER")
    rows = patients(spark, sf_dir).select(F.concat(F.lit(" Clip"), F.col("patient")).alias("video_id"), angle.alias("recording_angle"))
    return readers.read_recording_angles(spark, written(rows))


@query("totals_file", f"SELECT 'P' || patient AS ids, visit, med, score AS updrs_total FROM ({ORACLES['updrs_unpivot']})")
def totals_file(spark, sf_dir):
    long = updrs_unpivot(spark, sf_dir)
    wide = long.groupBy(F.concat(F.lit("P"), F.col("patient")).alias("IDS")).agg(
        *[
            F.max(F.when((F.col("visit") == v) & (F.col("med") == m), F.col("score"))).alias(f"UPDRS_V{v}_{m}")
            for v in (1, 2, 3)
            for m in ("Off", "On")
        ]
    )
    return readers.read_updrs_total(spark, written(wide, "\t"))


@query("series_file", with_ctes("frames", body=" SELECT video, frame_idx, round(round(seen, 2), 2) AS sample FROM frames"))
def series_file(spark, sf_dir):
    """Series as JSON text in a CSV log; missing samples stay missing and keep their place."""
    samples = frames(spark, sf_dir).select("video", "clip", "frame_idx", F.round("seen", 2).alias("sample"))
    packed = K.pack_signal(samples, ["sample"]).select("video", sinks.encode_series(F.col("sample")).alias("sample"))
    path = fresh(spark, ".csv")
    packed.write.option("header", True).option("escape", '"').csv(path)
    log = readers.read_tracking_log(spark, path, ["sample"])
    return log.select(F.col("video").cast("long").alias("video"), F.posexplode("sample").alias("frame_idx", "sample")).withColumn(
        "frame_idx", F.col("frame_idx").cast("long")
    )


@query(
    "report_files",
    with_ctes(
        "logs",
        body="""
, s AS (SELECT visit, count(*) AS n, round(avg(feature), 3) AS mean FROM logs GROUP BY visit)
SELECT 'csv' AS fmt, * FROM s UNION ALL SELECT 'json', * FROM s UNION ALL SELECT 'parquet', * FROM s""",
    ),
)
def report_files(spark, sf_dir):
    rows = recording_logs(spark, sf_dir).groupBy("visit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("feature"), 3).alias("mean"))
    rows, out = durable(rows), None
    for fmt in ("csv", "json", "parquet"):
        path = fresh(spark)
        sinks.write_report(rows, path, fmt)
        reader = spark.read.schema("visit int, n long, mean double")
        back = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path).select(F.lit(fmt).alias("fmt"), "*")
        out = back if out is None else out.unionByName(back)
    return out


_RATINGS_SQL = """
WITH k AS (SELECT o_orderkey AS video, CAST(o_orderkey % 5 AS DOUBLE) AS r1, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 4 AS DOUBLE) END AS r2,
   CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS r3 FROM orders)
, s AS (SELECT video, CAST(round_even(list_median([x FOR x IN [r1, r2, r3] IF x IS NOT NULL]), 0) AS INT) AS score FROM k)
"""


def _ratings(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("video"),
        F.when(key % 2 == 0, "Right").otherwise("Left").alias("hand"),
        (key % 5).cast("string").alias("r1"),
        F.when(key % 7 != 0, (key % 4).cast("string")).alias("r2"),
        F.when(key % 11 == 0, "bad").otherwise((key % 3).cast("string")).alias("r3"),
        *[F.when(key % p != 0, F.when(key % q == 0, "pd").otherwise("HT")).alias(f"d{i}") for i, p, q in ((1, 3, 2), (2, 6, 5), (3, 9, 4))],
    )


@query(
    "rater_votes",
    _RATINGS_SQL
    + """
, d AS (SELECT o_orderkey AS video, [x FOR x IN [CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 = 0 END, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 5 = 0 END,
   CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 4 = 0 END] IF x IS NOT NULL] AS v FROM orders)
SELECT video, score, CASE WHEN len(v) > 0 THEN CASE WHEN 2 * len([x FOR x IN v IF x]) > len(v) THEN 'PD' ELSE 'HT' END END AS diagnosis FROM s JOIN d USING (video)""",
)
def rater_votes(spark, sf_dir):
    votes = readers.rater_diagnosis(["d1", "d2", "d3"])
    return _ratings(spark, sf_dir).select("video", readers.rater_score(RATERS).alias("score"), votes.alias("diagnosis"))


@query(
    "dataset_files",
    _RATINGS_SQL
    + """
, t AS (SELECT printf('TULIP_%03d', video) AS ids, 1 AS visit, 'Off' AS medication_state,
   CASE WHEN video % 2 = 0 THEN 'Right' ELSE 'Left' END AS hand, score FROM s)
SELECT ids, visit, medication_state, hand, score AS score_clean, ids AS patient_id FROM t""",
)
def dataset_files(spark, sf_dir):
    """Score table and id map of a data set, written, read back and joined."""
    ratings = _ratings(spark, sf_dir).withColumnRenamed("video", "subject_num")
    videos = ratings.select(
        F.format_string("TULIP_%03d", F.col("subject_num")).alias("subject_id"),
        F.lit(0).alias("camera"),
        F.concat(F.lit("/v/"), F.col("subject_num"), F.lit(".mp4")).alias("video_path"),
    )
    paths = sinks.write_dataset(readers.dataset_tables(videos, ratings, RATERS, [0]), fresh(spark))
    scores = readers.read_clinical_scores(spark, paths["scores"], "score")
    ids = readers.read_id_map(spark, paths["id_map"])
    joined = scores.join(ids, scores["ids"] == ids["video_id"], "left")
    return joined.select("ids", "visit", "medication_state", "hand", "score_clean", "patient_id")


@query(
    "unlogged_videos",
    "SELECT o_orderkey AS video FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 40) USING (o_orderkey)",
)
def unlogged_videos(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 40).select(F.col("l_orderkey").alias("video"))
    return jobs.unlogged(recording_logs(spark, sf_dir).select("video"), seen, "video")


@query(
    "valid_window",
    with_ctes(
        "frames",
        body="""
, b AS (SELECT video, clip, min(frame_idx) AS lo, max(frame_idx) AS hi FROM frames WHERE seen IS NOT NULL GROUP BY ALL)
SELECT video, clip, frame_idx, seen FROM frames JOIN b USING (video, clip) WHERE frame_idx BETWEEN lo AND hi""",
    ),
)
def valid_window(spark, sf_dir):
    return S.trim_to_valid(frames(spark, sf_dir), "seen").select(*KEYS, "frame_idx", "seen")


@query(
    "half_cycle_intervals",
    with_ctes(
        "frames",
        body=_ALT_SQL
        + f"""
SELECT video, clip, frame_idx, round(gap / {FPS}, 6) AS interval_s FROM (SELECT *, frame_idx - lag(frame_idx) OVER ({W}) AS gap FROM alt) WHERE gap IS NOT NULL""",
    ),
)
def half_cycle_intervals(spark, sf_dir):
    _, raw = _raw_extrema(spark, sf_dir)
    return K.half_intervals(S.alternate(sliced(raw)), FPS).withColumn("interval_s", F.round("interval_s", 6))


@query(
    "helper_columns",
    with_ctes(
        "logs",
        "cyclefeat",
        body="""
, f AS (SELECT l.video, l.score, 10 + l.video % 60 AS fps, pause_time_ratio AS p, mean_amplitude / 25 - 1 AS d, peak_velocity AS a FROM logs l JOIN cyclefeat USING (video))
SELECT video, CAST(CASE WHEN fps <= 25 THEN 1 ELSE greatest(1, floor(fps / 25.0)) END AS INT) AS stride,
  'MDS-UPDRS 3.6: ' || coalesce(CAST(CASE WHEN video % 8 <> 0 THEN score END AS VARCHAR), 'N/A') AS line,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'LARGE' END AS effect,
  round((a + pi()) - 2 * pi() * floor((a + pi()) / (2 * pi())) - pi(), 6) AS wrapped FROM f""",
    ),
)
def helper_columns(spark, sf_dir):
    df = recording_logs(spark, sf_dir).join(cycle_features(spark, sf_dir), "video")
    return df.select(
        "video",
        naming.frame_stride((F.lit(10) + F.col("video") % 60).cast("double"), 25.0).alias("stride"),
        naming.score_line("3.6", F.when(F.col("video") % 8 != 0, F.col("score"))).alias("line"),
        N.significance(F.col("pause_time_ratio")).alias("significance"),
        N.effect_label(F.col("mean_amplitude") / 25 - 1).alias("effect"),
        F.round(S.wrap_to_pi(F.col("peak_velocity")), 6).alias("wrapped"),
    )


@query(
    "label_confidence",
    """
SELECT vec_id, CASE label % 4 WHEN 0 THEN 0.0 WHEN 2 THEN 0.25 ELSE round(0.5 + label / 100.0, 6) END AS confidence,
  label % 3 = 0 OR label % 2 = 1 AS seen FROM embeddings""",
)
def label_confidence(spark, sf_dir):
    """Score of the expected hand, else of the best category, else 0; a missing visibility counts as visible."""
    best, kind = (F.lit(0.5) + F.col("label") / 100.0), F.col("label") % 4

    def category(name, score):
        return F.struct(F.lit(name).alias("label"), score.cast("double").alias("score"))

    none = F.array().cast("array<struct<label:string,score:double>>")
    found = (
        F.when(kind == 0, none)
        .when(kind == 1, F.array(category("Right", best)))
        .when(kind == 2, F.array(category("Right", best), category("Left", F.lit(0.25))))
        .otherwise(F.array(category("Left", best), category("Right", F.lit(0.25))))
    )
    visibility = F.when(F.col("label") % 3 != 0, (F.col("label") % 2).cast("double"))
    point = F.struct(*[F.lit(0.0).alias(a) for a in "xyz"], visibility.alias("v"))
    seen = G.with_visibility(F.array(point))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(G.expected_confidence(found, "Left"), 6).alias("confidence"), (G.point(seen, 0)["v"] > 0.5).alias("seen")
    )
