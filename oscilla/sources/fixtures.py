"""Star-schema tables in the roles of the engine's own inputs.

No clinical data ships with the engine, so the registered queries read the given tables through
the role mapping below.  Each Spark role has a SQL twin in ``CTE``, used by the reference SQL.
Every role reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.config import DEFAULTS
from oscilla.functions import normalize
from oscilla.operators.ordering import SLICE, to_recordings

# embeddings have no recording of their own: so many in a row play one
LANDMARK_FRAMES = 250
FEATURES = [
    "mean_amplitude",
    "peak_velocity",
    "mean_velocity",
    "global_velocity",
    "amplitude_cv",
    "rhythm_cv",
    "pause_time_ratio",
    "arm_swing",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def recording_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tracking logs: one row per recording."""
    o = table(spark, sf_dir, "orders")
    key, patient = F.col("o_orderkey"), F.col("o_custkey")
    visit = (F.year("o_orderdate") % 3 + 1).cast("int")
    med = F.when(F.col("o_orderstatus") == "O", "On").when(F.col("o_orderstatus") == "F", "Off")
    hand = F.when(key % 2 == 0, "Right").otherwise("Left")
    token = F.concat(F.lit("POM"), visit.cast("string"), F.lit("VD"), padded(patient, 7))
    side = F.concat(F.coalesce(med, F.lit("Unk")), F.lit("_4"), F.substring(hand, 1, 1))
    path = (
        F.when(
            key % 4 == 0,
            F.concat(
                F.lit("/data/Video/Visit "), visit.cast("string"), F.lit("/"), token, F.lit("/"),
                side, F.lit("  clip_Cropped.mp4"),
            ),
        )
        .when(
            key % 4 == 1,
            F.concat(
                F.lit("/mnt/Subject_"), (patient % 1200).cast("string"),
                F.lit("/13. Pronation_and_supination_"), F.lower(hand), F.lit("/cam"),
                (key % 3).cast("string"), F.lit(".mp4"),
            ),
        )
        .when(
            key % 4 == 2,
            F.concat(
                F.lit("/mnt/segmented_video_"), token, F.lit("_PS_"), visit.cast("string"),
                F.lit("_"), side, F.lit("_cropped.mp4"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("C:\\out\\Enhanced_videos2_"), (key % 5000).cast("string"),
                F.lit("_cl_sh_sr4x.mp4"),
            )
        )
    )
    return o.select(
        key.alias("video"),
        patient.alias("patient"),
        visit.alias("visit"),
        med.alias("med"),
        hand.alias("hand"),
        (F.substring("o_orderpriority", 1, 1).try_cast("int") - 1).alias("score"),
        F.when(key % 50 == 7, "ERROR").otherwise("VIDEO").alias("record_type"),
        F.col("o_totalprice").alias("feature"),
        F.when(key % 11 != 0, F.col("o_totalprice") / 560000.0).alias("quality"),
        F.col("o_orderdate").alias("recorded_at"),
        path.alias("video_path"),
    )


def cycle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cycles, aggregated to features per recording (partial aggregation applies)."""
    li = table(spark, sf_dir, "lineitem")
    mean_q, mean_d = F.avg("l_quantity"), F.avg("l_discount")
    raw = {
        "mean_amplitude": mean_q,
        "peak_velocity": F.max("l_extendedprice") / 993,
        "mean_velocity": F.avg("l_extendedprice") / 993,
        "global_velocity": F.sum("l_extendedprice") / 4993,
        "amplitude_cv": F.when(mean_q > 0, F.stddev_pop("l_quantity") / mean_q * 100),
        "rhythm_cv": F.when(mean_d > 0, F.stddev_pop("l_discount") / mean_d * 100),
        "pause_time_ratio": mean_d,
        "arm_swing": F.avg("l_tax"),
    }
    # rounding makes equal features equal whatever the summation order, so that ranks agree
    return li.groupBy(F.col("l_orderkey").alias("video")).agg(
        *[F.round(c, 7).alias(n) for n, c in raw.items()],
        F.count(F.lit(1)).alias("total_cycles"),
        F.count_if(F.col("l_discount") > 0.07).alias("num_hesitations"),
    )


def feature_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking logs with their features; recordings without cycles keep NULL features."""
    return recording_logs(spark, sf_dir).join(cycle_features(spark, sf_dir), "video", "left")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as patients with demographics, recording angle and site."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("patient"),
        (F.lit(20) + F.col("c_custkey") % 70).cast("double").alias("age"),
        (F.col("c_custkey") % 2 + 1).cast("double").alias("gender_code"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("site"),
        F.col("c_acctbal").alias("balance"),
    )


def frames(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """events as frame-ordered signals, one whole recording (video, clip) per user.

    ``gap`` marks samples the tracker lost; ``seen`` is the sample with those set to NULL.
    """
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"),
        "ts",
        "event_id",
        "value",
        *[F.col(c) for c in columns],
    )
    numbered = to_recordings(e, ["video"], ["ts", "event_id"])
    gap = F.col("event_id") % 7 == 3
    return numbered.withColumn("seen", F.when(~gap, F.col("value")))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the ordered cycles of a recording, one whole recording per order."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video"),
        "l_shipdate",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").alias("amplitude"),
        (F.col("l_extendedprice") / 9973.0).alias("interval_s"),
        (F.col("l_extendedprice") / 97.0).alias("peak_velocity"),
    )
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "amplitude", "interval_s"]
    numbered = to_recordings(li, ["video"], order)
    return numbered.select(
        SLICE, "video", "clip", F.col("frame_idx").alias("cycle_no"), "amplitude", "interval_s", "peak_velocity"
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 21-point hand landmarks (a hand shape plus noise), 250 frames per recording."""
    e = table(spark, sf_dir, "embeddings")
    jump = F.when(F.col("label") == 9, 0.285).otherwise(0.0)

    def at(i, axis):
        return F.get("embedding", (i * 3 + axis).cast("int")).cast("double")

    points = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda i: F.struct(
            (F.lit(0.3) + i * 0.02 + at(i, 0) * 0.03 + jump).alias("x"),
            (F.lit(0.3) + (i * 7 % 21) * 0.015 + at(i, 1) * 0.03).alias("y"),
            at(i, 2).alias("z"),
            F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(at(i, 2)) * 4).alias("v"),
        ),
    )
    return e.select(
        F.floor(F.col("vec_id") / LANDMARK_FRAMES).cast("long").alias("video"),
        (F.col("vec_id") % LANDMARK_FRAMES).cast("long").alias("frame_idx"),
        F.col("label"),
        points.alias("lm"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hands as two detections per frame, the second one shifted to the right."""
    # renamed first: inside a lambda a column name would meet the new alias, not the old column
    lm = landmarks(spark, sf_dir).withColumnRenamed("frame_idx", "slot")
    det = F.col("slot") % 2
    return lm.select(
        "video",
        F.floor(F.col("slot") / 2).cast("long").alias("frame_idx"),
        det.alias("det_idx"),
        F.when(F.col("label") % 2 == det, "Left").otherwise("Right").alias("label"),
        (F.lit(0.5) + F.col("label") * 0.05).alias("score"),
        F.transform(
            "lm",
            lambda p: F.struct(
                (p["x"] + det * 0.35).alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["v"].alias("v")
            ),
        ).alias("lm"),
    )


# SQL twins of the roles above, as common table expressions.
CTE: dict[str, str] = {
    "logs": r"""
logs AS (
  SELECT *, CASE video % 4
      WHEN 0 THEN '/data/Video/Visit ' || visit || '/' || token || '/' || side || '  clip_Cropped.mp4'
      WHEN 1 THEN '/mnt/Subject_' || (patient % 1200) || '/13. Pronation_and_supination_' || lower(hand)
                  || '/cam' || (video % 3) || '.mp4'
      WHEN 2 THEN '/mnt/segmented_video_' || token || '_PS_' || visit || '_' || side || '_cropped.mp4'
      ELSE 'C:\out\Enhanced_videos2_' || (video % 5000) || '_cl_sh_sr4x.mp4' END AS video_path
  FROM (SELECT *, 'POM' || visit || 'VD' || lpad(CAST(patient AS VARCHAR), 7, '0') AS token,
               coalesce(med, 'Unk') || '_4' || substr(hand, 1, 1) AS side
        FROM (SELECT o_orderkey AS video, o_custkey AS patient,
                     CAST(year(o_orderdate) % 3 + 1 AS INT) AS visit,
                     CASE o_orderstatus WHEN 'O' THEN 'On' WHEN 'F' THEN 'Off' END AS med,
                     CASE WHEN o_orderkey % 2 = 0 THEN 'Right' ELSE 'Left' END AS hand,
                     TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS score,
                     CASE WHEN o_orderkey % 50 = 7 THEN 'ERROR' ELSE 'VIDEO' END AS record_type,
                     o_totalprice AS feature,
                     CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 560000.0 END AS quality,
                     o_orderdate AS recorded_at
              FROM orders)))""",
    "cyclefeat": """
cyclefeat AS (
  SELECT l_orderkey AS video, round(avg(l_quantity), 7) AS mean_amplitude,
         round(max(l_extendedprice) / 993, 7) AS peak_velocity, round(avg(l_extendedprice) / 993, 7) AS mean_velocity,
         round(sum(l_extendedprice) / 4993, 7) AS global_velocity,
         round(CASE WHEN avg(l_quantity) > 0 THEN stddev_pop(l_quantity) / avg(l_quantity) * 100 END, 7) AS amplitude_cv,
         round(CASE WHEN avg(l_discount) > 0 THEN stddev_pop(l_discount) / avg(l_discount) * 100 END, 7) AS rhythm_cv,
         round(avg(l_discount), 7) AS pause_time_ratio, round(avg(l_tax), 7) AS arm_swing, count(*) AS total_cycles,
         count(*) FILTER (l_discount > 0.07) AS num_hesitations
  FROM lineitem GROUP BY l_orderkey)""",
    "featlog": """
featlog AS (SELECT * FROM logs LEFT JOIN cyclefeat USING (video))""",
    "patients": """
patients AS (
  SELECT c_custkey AS patient, CAST(20 + c_custkey % 70 AS DOUBLE) AS age,
         CAST(c_custkey % 2 + 1 AS DOUBLE) AS gender_code, c_mktsegment AS segment,
         c_nationkey AS site, c_acctbal AS balance FROM customer)""",
    "frames": """
frames AS (
  SELECT *, CAST(0 AS BIGINT) AS clip, rn AS frame_idx,
         CASE WHEN event_id % 7 <> 3 THEN value END AS seen
  FROM (SELECT user_id AS video, ts, event_id, value, event_type, props,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events))""",
    "cycles": """
cycles AS (
  SELECT video, CAST(0 AS BIGINT) AS clip, rn AS cycle_no, amplitude, interval_s, peak_velocity
  FROM (SELECT l_orderkey AS video, l_quantity AS amplitude, l_extendedprice / 9973.0 AS interval_s,
               l_extendedprice / 97.0 AS peak_velocity,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
                 l_suppkey, l_quantity, l_extendedprice / 9973.0) - 1 AS rn
        FROM lineitem))""",
    "landmarks": f"""
landmarks AS (
  SELECT vec_id // {LANDMARK_FRAMES} AS video, vec_id % {LANDMARK_FRAMES} AS frame_idx, label,
         list_transform(range(0, 21), lambda i: {{
           'x': 0.3 + i * 0.02 + CAST(embedding[3 * i + 1] AS DOUBLE) * 0.03 + CASE WHEN label = 9 THEN 0.285 ELSE 0.0 END,
           'y': 0.3 + (i * 7 % 21) * 0.015 + CAST(embedding[3 * i + 2] AS DOUBLE) * 0.03,
           'z': CAST(embedding[3 * i + 3] AS DOUBLE),
           'v': greatest(0.0, 1.0 - abs(CAST(embedding[3 * i + 3] AS DOUBLE)) * 4)}}) AS lm
  FROM embeddings)""",
}


def with_ctes(*names: str, body: str) -> str:
    """Prefix ``body`` with the named common table expressions."""
    return "WITH " + ",".join(CTE[n] for n in names) + body
