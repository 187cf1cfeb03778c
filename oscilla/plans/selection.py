"""Event matching, curation, agreement, job bookkeeping and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.functions import normalize as N
from oscilla.operators import curation, jobs, folds, learn, matching, stats
from oscilla.plans.registry import query
from oscilla.session import durable
from oscilla.sources.fixtures import FEATURES, feature_log, frames, recording_logs, table, with_ctes

KEYS = ["video", "clip"]
TOL = 6.0  # hours in the event-table role


def _points(spark, sf_dir):
    """Clicks as detected and views as annotated events, in hours."""
    f = frames(spark, sf_dir, ("event_type",))
    # a difference of two zone-free timestamps does not depend on the session time zone
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    hours = micros / 3.6e9 - 473352.0
    side = F.when(F.col("event_type") == "click", "det").when(F.col("event_type") == "view", "man")
    return f.select(*KEYS, hours.alias("t"), side.alias("side")).filter(F.col("side").isNotNull())


_PTS_SQL = """, pt AS (SELECT video, clip, epoch_us(ts) / 3.6e9 - 473352.0 AS t, CASE event_type WHEN 'click' THEN 'det' WHEN 'view' THEN 'man' END AS side
  FROM frames WHERE event_type IN ('click', 'view'))"""


# A pair that is the best of both its points is what the greedy order takes first; matching all such
# pairs round by round, until none is left, gives the same matching.
_MATCH_SQL = (
    _PTS_SQL
    + f"""
, sides AS (SELECT video, clip, count(*) FILTER (side = 'det') AS nd, count(*) FILTER (side = 'man') AS nm FROM pt GROUP BY ALL)
, num AS (SELECT *, row_number() OVER (PARTITION BY video, clip, side ORDER BY t) AS i FROM pt)
, pairs AS (SELECT a.video, a.clip, a.i AS d, b.i AS m, abs(a.t - b.t) AS err FROM num a JOIN num b ON a.video = b.video AND a.clip = b.clip
   AND a.side = 'det' AND b.side = 'man' AND abs(a.t - b.t) <= {TOL})
, rounds AS (SELECT 0 AS r, video, clip, d, m, err, false AS hit FROM pairs UNION ALL
   SELECT r + 1, video, clip, d, m, err, best FROM (
     SELECT *, bool_or(best) OVER (PARTITION BY video, clip, d) AS kd, bool_or(best) OVER (PARTITION BY video, clip, m) AS km FROM (
       SELECT r, video, clip, d, m, err, row_number() OVER (PARTITION BY video, clip, d ORDER BY err, d, m) = 1
         AND row_number() OVER (PARTITION BY video, clip, m ORDER BY err, d, m) = 1 AS best FROM rounds WHERE NOT hit))
   WHERE best OR NOT (kd OR km))
, got AS (SELECT video, clip, count(*) AS tp, avg(err) AS e FROM rounds WHERE hit GROUP BY ALL)
, res AS (SELECT video, clip, nd AS n_detected, nm AS n_manual, coalesce(tp, 0) AS tp, nd - coalesce(tp, 0) AS fp, nm - coalesce(tp, 0) AS fn,
   round(coalesce(coalesce(tp, 0) / nullif(nd, 0), 0), 4) AS precision, round(coalesce(tp, 0) / nm, 4) AS recall,
   round(coalesce(2 * (coalesce(tp, 0) / nd) * (coalesce(tp, 0) / nm) / nullif(coalesce(tp, 0) / nd + coalesce(tp, 0) / nm, 0), 0), 4) AS f1,
   round(e, 4) AS mae_s, round(nd / nm, 4) AS count_ratio, nd - nm AS count_diff FROM sides LEFT JOIN got USING (video, clip) WHERE nm > 0)"""
)


def _match_sql(body: str) -> str:
    return with_ctes("frames", body=_MATCH_SQL + body).replace("WITH", "WITH RECURSIVE", 1)


def _packed(points):
    """The sorted times of both sides per recording."""
    return points.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "det", F.col("t")))).alias("det"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "man", F.col("t")))).alias("man"),
    )


@query("extrema_match", _match_sql(" SELECT * FROM res"))
def extrema_match(spark, sf_dir):
    return matching.cycle_accuracy(_packed(_points(spark, sf_dir)), KEYS, TOL)


_WINDOW_GAP_H = 24.0

_INSIDE_SQL = f"""
, gaps AS (SELECT video, clip, t, coalesce(t - lag(t) OVER (PARTITION BY video, clip ORDER BY t) > {_WINDOW_GAP_H}, true)::INT AS fresh FROM pt0 WHERE side = 'det')
, spans AS (SELECT video, clip, min(t) AS a, max(t) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY video, clip ORDER BY t) AS g FROM gaps) GROUP BY video, clip, g)
, pt AS (SELECT * FROM pt0 WHERE side = 'det' OR NOT EXISTS (SELECT 1 FROM spans s WHERE s.video = pt0.video AND s.clip = pt0.clip)
   OR EXISTS (SELECT 1 FROM spans s WHERE s.video = pt0.video AND s.clip = pt0.clip AND pt0.t BETWEEN s.a AND s.b))"""


@query(
    "accuracy_in_windows",
    _match_sql(" SELECT * FROM res").replace(_PTS_SQL, _PTS_SQL.replace(", pt AS", ", pt0 AS") + _INSIDE_SQL),
)
def accuracy_in_windows(spark, sf_dir):
    """Annotations outside the active spans of the detections don't count."""
    points = durable(_points(spark, sf_dir))
    detected = points.filter("side = 'det'")
    spans = matching.sessions(detected, KEYS, _WINDOW_GAP_H)
    annotated = matching.inside_windows(points.filter("side = 'man'"), spans, KEYS)
    return matching.cycle_accuracy(_packed(detected.unionByName(annotated.filter("inside").drop("inside"))), KEYS, TOL)


@query(
    "accuracy_summary",
    _match_sql(
        """ SELECT count(*) AS n_videos, round(avg(precision), 8) AS mean_precision, round(avg(recall), 8) AS mean_recall, round(avg(f1), 8) AS mean_f1, round(avg(mae_s), 8) AS mean_mae_s,
  round(avg(count_ratio), 8) AS mean_count_ratio, round(avg(count_diff), 8) AS mean_count_diff, round(avg(mae_s) * 25, 7) AS mean_mae_frames FROM res"""
    ),
)
def accuracy_summary(spark, sf_dir):
    out = matching.accuracy_summary(extrema_match(spark, sf_dir))
    return out.withColumns(
        {c: F.round(c, 7 if c == "mean_mae_frames" else 8) for c in out.columns if c != "n_videos"}
    )


@query("worst_videos", _match_sql(" SELECT * FROM res ORDER BY f1, video, clip LIMIT 5"))
def worst_videos(spark, sf_dir):
    return matching.worst_videos(extrema_match(spark, sf_dir), KEYS)


@query(
    "hausdorff_w1",
    with_ctes(
        "frames",
        body=_PTS_SQL
        + """
, n AS (SELECT video, clip, count(*) FILTER (side = 'det') AS nd, count(*) FILTER (side = 'man') AS nm FROM pt GROUP BY ALL HAVING count(*) FILTER (side = 'man') > 0)
, d AS (SELECT a.video, a.clip, a.t, min(abs(a.t - b.t)) AS x FROM pt a JOIN pt b ON a.video = b.video AND a.clip = b.clip AND a.side = 'det' AND b.side = 'man' GROUP BY ALL)
, m AS (SELECT a.video, a.clip, a.t, min(abs(a.t - b.t)) AS x FROM pt a JOIN pt b ON a.video = b.video AND a.clip = b.clip AND a.side = 'man' AND b.side = 'det' GROUP BY ALL)
, da AS (SELECT video, clip, avg(x) AS a, max(x) AS h FROM d GROUP BY ALL), ma AS (SELECT video, clip, avg(x) AS a, max(x) AS h FROM m GROUP BY ALL)
, c AS (SELECT video, clip, t, lead(t) OVER w AS nx, count(*) FILTER (side = 'det') OVER w AS cd, count(*) FILTER (side = 'man') OVER w AS cm FROM pt WINDOW w AS (PARTITION BY video, clip ORDER BY t, side))
, w AS (SELECT c.video, c.clip, sum(abs(cd / nd - cm / nm) * (nx - t)) AS w FROM c JOIN n USING (video, clip) GROUP BY ALL)
, mm AS (SELECT video, clip, avg(t) AS mt FROM pt WHERE side = 'man' GROUP BY ALL)
SELECT n.video, n.clip, round(CASE WHEN nd > 0 THEN da.a END, 6) AS nn_det_to_man, round(CASE WHEN nd > 0 THEN ma.a END, 6) AS nn_man_to_det, round(CASE WHEN nd > 0 THEN (da.a + ma.a) / 2 END, 6) AS sym_nn,
 round(CASE WHEN nd > 0 THEN greatest(da.h, ma.h) END, 6) AS hausdorff, round(CASE WHEN nd > 0 THEN w ELSE mt END, 6) AS wasserstein
FROM n LEFT JOIN da USING (video, clip) LEFT JOIN ma USING (video, clip) LEFT JOIN w USING (video, clip) LEFT JOIN mm USING (video, clip)""",
    ),
)
def hausdorff_w1(spark, sf_dir):
    out = matching.set_distances(_points(spark, sf_dir), KEYS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in KEYS})


@query(
    "extrema_union",
    with_ctes(
        "frames",
        body=_PTS_SQL
        + " SELECT video, clip, len(list(DISTINCT round(t, 6))) AS n, round(list_sum(list(DISTINCT round(t, 6))), 6) AS total FROM pt GROUP BY ALL",
    ),
)
def extrema_union(spark, sf_dir):
    lists = _points(spark, sf_dir).groupBy(*KEYS, "side").agg(F.collect_list("t").alias("times"))
    merged = matching.merge_extrema(lists, KEYS, "times")
    return merged.select(
        *KEYS, F.size("times").alias("n"),
        F.round(F.aggregate("times", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


def _eligible(spark, sf_dir):
    f = feature_log(spark, sf_dir)
    return curation.eligibility(
        f.select(
            "video",
            F.col("quality").alias("signal_quality"),
            (1 - F.col("pause_time_ratio")).alias("detection_rate"),
            (F.col("mean_amplitude") / 50).alias("mcp_confidence"),
            F.col("peak_velocity").alias("sharpness"),
            F.col("arm_swing").alias("gap_fraction"),
            F.col("global_velocity").alias("bbox_area"),
            (F.col("amplitude_cv") * 2).alias("luminance"),
            (F.coalesce("total_cycles", F.lit(0)) + 1).alias("frames"),
        )
    )


_PLE_SQL = """
, e AS (SELECT video, coalesce(quality, 0) AS sq, coalesce(1 - pause_time_ratio, 0) AS dr, coalesce(mean_amplitude / 50, 0) AS mc, coalesce(peak_velocity, 0) AS sh,
   coalesce(arm_swing, 1) AS gp, coalesce(global_velocity, 0) AS bb, coalesce(amplitude_cv * 2, 128) AS lu, coalesce(total_cycles, 0) + 1 AS frames FROM featlog)
, x AS (SELECT min(sh) AS s0, max(sh) AS s1, min(bb) AS b0, max(bb) AS b1 FROM e)
, ple AS (SELECT video, frames, greatest(0, least(1, (3 * sq + 2 * dr + 2 * mc + 1.5 * (sh - s0) / greatest(s1 - s0, 1e-8) + 1.5 * (1 - gp) + (bb - b0) / greatest(b1 - b0, 1e-8)
   + 0.5 * greatest(0, least(1, 1 - abs(lu - 128) / 128))) / 11.5)) AS ple FROM e, x)"""


@query(
    "ple_scores",
    with_ctes("logs", "cyclefeat", "featlog", body=_PLE_SQL + " SELECT video, round(ple, 9) AS ple FROM ple"),
)
def ple_scores(spark, sf_dir):
    return _eligible(spark, sf_dir).select("video", F.round("ple", 9).alias("ple"))


@query(
    "budget_threshold",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_PLE_SQL
        + """
, o AS (SELECT round(ple, 9) AS ple, row_number() OVER (ORDER BY round(ple, 9) DESC, video) - 1 AS i, sum(frames) OVER (ORDER BY round(ple, 9) DESC, video) AS cf FROM ple)
, g AS (SELECT i, cf, abs(ple - lag(ple) OVER (ORDER BY i)) / greatest(cf - lag(cf) OVER (ORDER BY i), 1) AS g FROM o)
, md AS (SELECT median(g) AS m FROM g WHERE g > 0)
, k AS (SELECT count(*) AS n, max(i) FILTER (cf <= 25000) AS lw, min(i) FILTER (cf >= 5000) AS fe, (SELECT min(i) FROM g, md WHERE g > 2 * m AND cf >= 5000) AS el FROM o)
, c AS (SELECT n, greatest(least(greatest(coalesce(el, lw, n - 1), coalesce(fe, n - 1)), coalesce(lw, greatest(coalesce(el, lw, n - 1), coalesce(fe, n - 1)))), least(49, n - 1)) AS ix FROM k)
SELECT i AS rank, ple AS score, CAST(cf AS BIGINT) AS frames FROM o, c WHERE i = ix""",
    ),
)
def budget_threshold(spark, sf_dir):
    scored = durable(
        _eligible(spark, sf_dir).select("video", "frames", F.round("ple", 9).alias("ple"))
    )
    return curation.selection_threshold(scored, "ple", "frames", "video")


_SHARE_SQL = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR) || ':42'), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "train_val_split",
    f"SELECT o_orderkey AS video, o_custkey AS patient, CASE WHEN {_SHARE_SQL.format(k='o_custkey')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM orders",
)
def train_val_split(spark, sf_dir):
    df = recording_logs(spark, sf_dir).select("video", "patient")
    return curation.train_val_split(df, "patient", 0.2, 42)


_DET_SQL = """
WITH a AS (SELECT l_orderkey AS k, avg(l_extendedprice) AS amp, avg(l_discount) AS rate FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey AS k, avg(l_quantity * p_retailprice) AS amp, avg(l_discount) * 0.9 + 0.01 AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


def _two_logs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.avg("l_extendedprice").alias("amp"), F.avg("l_discount").alias("rate")
    )
    b = li.join(part, li["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").alias("k")).agg(
        F.avg(F.col("l_quantity") * F.col("p_retailprice")).alias("amp"),
        (F.avg("l_discount") * 0.9 + 0.01).alias("rate"),
    )
    return a, b


@query(
    "icc_agreement",
    _DET_SQL
    + """, j AS (SELECT a.amp AS a1, b.amp AS a2, a.rate AS r1, b.rate AS r2 FROM a JOIN b USING (k))
SELECT 'amp' AS feature, count(*) AS n, round((var_samp((a1 + a2) / 2) - var_samp(a1 - a2) / 2) / (var_samp((a1 + a2) / 2) + var_samp(a1 - a2) / 2), 8) AS icc FROM j UNION ALL
SELECT 'rate', count(*), round((var_samp((r1 + r2) / 2) - var_samp(r1 - r2) / 2) / (var_samp((r1 + r2) / 2) + var_samp(r1 - r2) / 2), 8) FROM j""",
)
def icc_agreement(spark, sf_dir):
    a, b = _two_logs(spark, sf_dir)
    return curation.agreement(a, b, "k", ["amp", "rate"]).withColumn("icc", F.round("icc", 8))


@query(
    "detector_assessment",
    _DET_SQL
    + """, j AS (SELECT a.amp AS a1, b.amp AS a2, a.rate AS r1, b.rate AS r2 FROM a JOIN b USING (k))
, i AS (SELECT (var_samp((a1 + a2) / 2) - var_samp(a1 - a2) / 2) / (var_samp((a1 + a2) / 2) + var_samp(a1 - a2) / 2) AS ai,
  (var_samp((r1 + r2) / 2) - var_samp(r1 - r2) / 2) / (var_samp((r1 + r2) / 2) + var_samp(r1 - r2) / 2) AS fi FROM j)
, r AS (SELECT (avg(r2) - avg(r1)) / greatest(abs(avg(r1)), 1e-8) * 100 AS p FROM j WHERE r1 < 0.03)
SELECT round(ai, 7) AS amplitude_icc, round(fi, 7) AS frequency_icc, round(p, 6) AS detection_rescue_pct, ai > 0.9 AND fi > 0.9 AS icc_pass, p > 15 AS rescue_pass FROM i, r""",
)
def detector_assessment(spark, sf_dir):
    a, b = _two_logs(spark, sf_dir)
    icc = curation.agreement(a, b, "k", ["amp", "rate"])
    rescue = curation.rescue_rate(a, b, "k", ["rate"], F.col("rate") < 0.03)
    out = curation.assessment(icc, rescue, "amp", "rate", "rate")
    digits = {"amplitude_icc": 7, "frequency_icc": 7, "detection_rescue_pct": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "detector_steadiness",
    """WITH j AS (SELECT l_orderkey, median(l_quantity / 50.0) FILTER (l_linenumber < 7) AS a, median(l_discount * 10.0) FILTER (l_quantity > 5) AS b FROM lineitem GROUP BY l_orderkey)
SELECT round(avg(a), 8) AS mean_conf_a, round(avg(b), 8) AS mean_conf_b, round((avg(b) - avg(a)) / greatest(abs(avg(a)), 1e-8) * 100, 6) AS improvement_pct FROM j""",
)
def detector_steadiness(spark, sf_dir):
    """The lines of an order as the frames of a recording, with a hole or two."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")

    def log(value, seen):
        shown = F.coalesce(F.when(seen, value), F.lit(float("nan")))
        return lines.groupBy("l_orderkey").agg(F.collect_list(shown).alias("series"))

    a = log(F.col("l_quantity") / 50.0, F.col("l_linenumber") < 7)
    b = log(F.col("l_discount") * 10.0, F.col("l_quantity") > 5)
    out = curation.steadiness(a, b, "l_orderkey", "series")
    return out.select(F.round("mean_conf_a", 8).alias("mean_conf_a"), F.round("mean_conf_b", 8).alias("mean_conf_b"), F.round("improvement_pct", 6).alias("improvement_pct"))


# bookkeeping


@query(
    "list_membership",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'first' WHEN a.k IS NULL THEN 'second' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k""",
)
def list_membership(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return jobs.membership(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), ["k"])


@query(
    "resume_antijoin",
    with_ctes(
        "logs",
        body="""
, t AS (SELECT video FROM logs), g AS (SELECT video FROM logs WHERE video % 3 <> 0 AND record_type = 'VIDEO' AND (video % 7 = 0 OR video % 5 <> 0))
SELECT video FROM t ANTI JOIN g USING (video)""",
    ),
)
def resume_antijoin(spark, sf_dir):
    logs = recording_logs(spark, sf_dir)
    video = F.col("video")
    empty = F.array().cast("array<double>")
    log = logs.filter(video % 3 != 0).select(
        "video",
        "record_type",
        (video % 7 != 0).alias("found"),
        F.when(video % 10 == 0, F.array(F.lit(None).cast("double"))).when(video % 5 == 0, empty).otherwise(
            F.array(F.lit(0.9), F.lit(None).cast("double"))
        ).alias("conf_min"),
        F.array(F.lit(1.0)).alias("conf_used"),
    )
    done = jobs.valid_payload(F.col("found"), F.col("conf_min"), F.col("conf_used"))
    return jobs.remaining(logs.select("video"), log, ["video"], done)


@query(
    "keep_last_log",
    """
WITH a AS (SELECT o_custkey AS task, o_orderkey AS seq, o_totalprice AS v, NULL AS extra FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_custkey, o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1)
SELECT task, max(seq) AS seq, arg_max_null(v, seq) AS v, arg_max_null(extra, seq) AS extra FROM a GROUP BY task""",
)
def keep_last_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    first = o.filter(key % 2 == 0).select(
        F.col("o_custkey").alias("task"), key.alias("seq"), F.col("o_totalprice").alias("v")
    )
    second = o.filter(key % 2 == 1).select(
        F.col("o_custkey").alias("task"), key.alias("seq"), F.col("o_orderstatus").alias("extra")
    )
    return jobs.keep_last([first, second], ["task"], "seq")


@query(
    "node_stripe",
    "SELECT o_orderkey AS video FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) WHERE i % 4 = 1",
)
def node_stripe(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_totalprice", F.col("o_orderkey").alias("video"))
    return jobs.stripe(tasks, ["o_totalprice", "video"], 4, 1).select("video")


@query(
    "node_slice",
    """SELECT o_orderkey AS video FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
WHERE i >= round_even(n * 0.25, 0) AND i < round_even(n * 0.6, 0)""",
)
def node_slice(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_totalprice", F.col("o_orderkey").alias("video"))
    return jobs.proportional_slice(tasks, ["o_totalprice", "video"], 0.25, 0.6).select("video")


@query(
    "retry_list",
    with_ctes(
        "logs",
        body=" SELECT patient, visit FROM logs GROUP BY ALL HAVING count(*) FILTER (record_type = 'VIDEO') = 0",
    ),
)
def retry_list(spark, sf_dir):
    return jobs.to_retry(recording_logs(spark, sf_dir), ["patient", "visit"])


@query(
    "seeded_sample",
    f"SELECT o_orderkey AS video FROM orders ORDER BY {_SHARE_SQL.format(k='o_orderkey')}, o_orderkey LIMIT 100",
)
def seeded_sample(spark, sf_dir):
    return jobs.sample(recording_logs(spark, sf_dir).select("video"), "video", 100, 42)


# models


@query("pca_varimax")
def pca_varimax(spark, sf_dir):
    return learn.pca_varimax(feature_log(spark, sf_dir), FEATURES)


@query(
    "loso_mean",
    with_ctes(
        "logs",
        body="""
, p AS (SELECT patient, count(*) AS n, sum(score) AS s FROM logs WHERE score IS NOT NULL GROUP BY patient), t AS (SELECT sum(n) AS n, sum(s) AS s FROM p)
SELECT patient, count(*) AS n, round(any_value((t.s - p.s) / (t.n - p.n)), 9) AS prediction FROM logs JOIN p USING (patient), t WHERE score IS NOT NULL GROUP BY patient""",
    ),
)
def loso_mean(spark, sf_dir):
    out = learn.loso_mean(recording_logs(spark, sf_dir).select("patient", "score"), "score", "patient")
    return out.groupBy("patient").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("prediction"), 9).alias("prediction")
    )


_LOSO_SQL = """
, d AS (SELECT video, patient, CAST(score AS DOUBLE) AS y, mean_amplitude AS x FROM featlog WHERE mean_amplitude IS NOT NULL)
, c AS (SELECT *, x - (SELECT avg(x) FROM d) AS zx, y - (SELECT avg(y) FROM d) AS zy FROM d)
, p AS (SELECT patient, count(*) AS n, sum(zx) AS sx, sum(zy) AS sy, sum(zx * zx) AS sxx, sum(zx * zy) AS sxy FROM c GROUP BY patient)
, t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM p)
, m AS (SELECT patient, t.n - p.n AS m, (t.sx - p.sx) / (t.n - p.n) AS mx, (t.sy - p.sy) / (t.n - p.n) AS my, (t.sxx - p.sxx) / (t.n - p.n) AS qxx, (t.sxy - p.sxy) / (t.n - p.n) AS qxy FROM p, t)
, b AS (SELECT patient, mx, my, m * (qxy - mx * my) / sqrt(qxx - mx * mx) / (m + 1.0) / sqrt(qxx - mx * mx) AS b FROM m)
, pr AS (SELECT video, y, my - b * mx + b * zx + (SELECT avg(y) FROM d) AS pred FROM c JOIN b USING (patient))"""


@query(
    "loso_ridge",
    with_ctes("logs", "cyclefeat", "featlog", body=_LOSO_SQL + " SELECT video, round(pred, 8) AS prediction FROM pr"),
)
def loso_ridge(spark, sf_dir):
    out = learn.loso_ridge(_scored(spark, sf_dir), ["mean_amplitude"], "y", "patient")
    return out.select("video", F.round("prediction", 8).alias("prediction"))


def _scored(spark, sf_dir):
    """The feature table with its scores, written once for the passes of a model."""
    return durable(
        feature_log(spark, sf_dir).select(
            "video", "patient", F.col("score").cast("double").alias("y"), "score", *FEATURES
        )
    )


@query(
    "regression_metrics",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_LOSO_SQL
        + """
, q AS (SELECT y, round(pred, 8) AS pred FROM pr)
, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS b FROM q)
SELECT round(avg(abs(y - pred)), 8) AS mae, round(sqrt(avg((y - pred)^2)), 8) AS rmse, round(1 - avg((y - pred)^2) / var_pop(y), 8) AS r2, (SELECT round(corr(a, b), 7) FROM r) AS spearman FROM q""",
    ),
)
def regression_metrics(spark, sf_dir):
    out = learn.loso_ridge(_scored(spark, sf_dir), ["mean_amplitude"], "y", "patient")
    out = out.select("y", F.round("prediction", 8).alias("prediction"))
    m = stats.regression_metrics(out, "y", "prediction")
    return m.select(*[F.round(c, 8).alias(c) for c in ("mae", "rmse", "r2")], F.round("spearman", 7).alias("spearman"))


_CLASS_SQL = """
, k AS (SELECT score AS y, CAST(floor(global_velocity / 10) AS INT) % 5 AS p FROM featlog WHERE global_velocity IS NOT NULL AND score IS NOT NULL)"""


def _predicted(spark, sf_dir):
    f = feature_log(spark, sf_dir).filter(F.col("global_velocity").isNotNull() & F.col("score").isNotNull())
    return f.select("score", (F.floor(F.col("global_velocity") / 10) % 5).cast("int").alias("predicted"))


@query(
    "loso_metrics",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_CLASS_SQL
        + """
, c AS (SELECT DISTINCT y AS c FROM k UNION SELECT DISTINCT p FROM k)
, s AS (SELECT c, (SELECT count(*) FROM k WHERE y = c) AS t, (SELECT count(*) FROM k WHERE p = c) AS p, (SELECT count(*) FROM k WHERE y = c AND p = c) AS h FROM c)
, m AS (SELECT *, coalesce(h / nullif(p, 0), 0) AS pr, h / nullif(t, 0) AS rc FROM s)
SELECT round(sum(h) / sum(t) * 100, 8) AS accuracy, round(avg(rc) * 100, 8) AS balanced_accuracy, round(avg(pr) * 100, 8) AS macro_precision,
 round(avg(coalesce(2 * pr * coalesce(rc, 0) / nullif(pr + coalesce(rc, 0), 0), 0)) * 100, 8) AS macro_f1 FROM m""",
    ),
)
def loso_metrics(spark, sf_dir):
    out = stats.classification_metrics(_predicted(spark, sf_dir), "score", "predicted")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query(
    "confusion_matrix",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body=_CLASS_SQL
        + " SELECT y AS score, p AS predicted, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY y), 8) AS pct FROM k GROUP BY y, p",
    ),
)
def confusion_matrix(spark, sf_dir):
    cells = stats.confusion(_predicted(spark, sf_dir), "score", "predicted")
    rows = cells.groupBy("score").agg(F.sum("n").alias("_t"))
    return cells.join(rows, "score").select(
        "score", "predicted", "n", F.round(100.0 * F.col("n") / F.col("_t"), 8).alias("pct")
    )


@query("severity_cv")
def severity_cv(spark, sf_dir):
    df = _scored(spark, sf_dir)
    df = df.withColumn("severity", F.when(F.col("score") <= 1, 0).when(F.col("score") == 2, 1).otherwise(2))
    model = learn.classifiers()["logistic_regression"]
    pred = learn.cross_validate(df, FEATURES, "severity", "patient", model)
    return stats.classification_metrics(pred, "severity", "prediction")


@query("ordinal_cv")
def ordinal_cv(spark, sf_dir):
    df = _scored(spark, sf_dir).withColumn(
        "severity", F.when(F.col("score") <= 1, 0).when(F.col("score") == 2, 1).otherwise(2)
    )
    pred = learn.ordinal_cross_validate(df, FEATURES, "severity", "patient", 3)
    return stats.classification_metrics(pred, "severity", "prediction")


def _severity(spark, sf_dir):
    score = F.col("score")
    return _scored(spark, sf_dir).withColumn("severity", F.when(score <= 1, 0).when(score == 2, 1).otherwise(2))


@query("severity_loso")
def severity_loso(spark, sf_dir):
    """Every recording predicted by a model of all other subjects."""
    return folds.loso_newton(_severity(spark, sf_dir), FEATURES, "severity", "patient", keep=["video"])


@query("ordinal_loso")
def ordinal_loso(spark, sf_dir):
    """The same by a proportional-odds model, over the scores themselves."""
    df = _scored(spark, sf_dir)
    return folds.loso_newton(df, FEATURES, "score", "patient", folds.ProportionalOdds, balanced=False, keep=["video"])


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return learn.feature_importance(_scored(spark, sf_dir), FEATURES, "score")


@query(
    "meta_encoding",
    with_ctes(
        "logs",
        body=" SELECT CASE med WHEN 'On' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS med_enc, CASE hand WHEN 'Right' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hand_enc, count(*) AS n FROM logs GROUP BY ALL",
    ),
)
def meta_encoding(spark, sf_dir):
    logs = recording_logs(spark, sf_dir)
    return logs.groupBy(
        F.when(N.medication_state(F.col("med")) == "On", 1.0).otherwise(0.0).alias("med_enc"),
        F.when(N.hand(F.col("hand")) == "Right", 1.0).otherwise(0.0).alias("hand_enc"),
    ).agg(F.count(F.lit(1)).alias("n"))
