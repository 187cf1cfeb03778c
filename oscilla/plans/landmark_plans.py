"""Landmark, tracking and recording-level kinematics queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from oscilla.config import DEFAULTS
from oscilla.operators import geometry as G
from oscilla.operators import kinematics as K
from oscilla.operators import quality, tracking
from oscilla.operators import sequence as S
from oscilla.plans.registry import query
from oscilla.sources.fixtures import (
    cycle_features,
    detections,
    feature_log,
    frames,
    landmarks,
    table,
    with_ctes,
)
from oscilla.sources.sinks import fixed_length

FPS = 25.0
W = "PARTITION BY video ORDER BY frame_idx"
# the points that carry the kinematics, by their 1-based list position
_PTS = ", pts AS (SELECT *, lm[1] AS w, lm[6] AS i, lm[10] AS m, lm[14] AS r, lm[18] AS p FROM landmarks)"


def _rounded(df, keys, digits, *columns):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


@query(
    "landmark_angles",
    with_ctes(
        "landmarks",
        body=_PTS
        + """
, k AS (SELECT *, p.x - i.x AS ax, p.y - i.y AS ay, r.x - i.x AS bx, r.y - i.y AS byy, p.x - m.x AS cx, p.y - m.y AS cy,
  m.x - w.x AS ux, m.y - w.y AS uy, m.z - w.z AS uz, i.x - w.x AS dx, i.y - w.y AS dy, i.z - w.z AS dz, p.x - w.x AS ex, p.y - w.y AS ey, p.z - w.z AS ez FROM pts)
, n0 AS (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS ul, sqrt(dx*dx+dy*dy+dz*dz) AS dl, dy*ez-dz*ey AS nx, dz*ex-dx*ez AS ny, dx*ey-dy*ex AS nz FROM k)
, n1 AS (SELECT *, ux/ul AS u1, uy/ul AS u2, uz/ul AS u3, dx/dl AS d1, dy/dl AS d2, dz/dl AS d3, sqrt(nx*nx+ny*ny+nz*nz) AS nl FROM n0)
, n2 AS (SELECT *, d1-(d1*u1+d2*u2+d3*u3)*u1 AS b1, d2-(d1*u1+d2*u2+d3*u3)*u2 AS b2, d3-(d1*u1+d2*u2+d3*u3)*u3 AS b3 FROM n1)
, n3 AS (SELECT *, b1/sqrt(b1*b1+b2*b2+b3*b3) AS f1, b2/sqrt(b1*b1+b2*b2+b3*b3) AS f2, b3/sqrt(b1*b1+b2*b2+b3*b3) AS f3 FROM n2)
, n4 AS (SELECT *, u2*f3-u3*f2 AS g1, u3*f1-u1*f3 AS g2, u1*f2-u2*f1 AS g3 FROM n3)
SELECT video, frame_idx, round(degrees(atan2(ay, ax)), 6) AS proxy_deg,
  round(atan2(ay/sqrt(ax*ax+ay*ay) + byy/sqrt(bx*bx+byy*byy) + cy/sqrt(cx*cx+cy*cy), ax/sqrt(ax*ax+ay*ay) + bx/sqrt(bx*bx+byy*byy) + cx/sqrt(cx*cx+cy*cy)), 8) AS knuckle,
  round(atan2((nx*g1+ny*g2+nz*g3)/nl/sqrt(g1*g1+g2*g2+g3*g3), (nx*f1+ny*f2+nz*f3)/nl), 6) AS roll,
  CASE WHEN w.x > 0.5 THEN 'Left' ELSE 'Right' END AS hand FROM n4""",
    ),
)
def landmark_angles(spark, sf_dir):
    df = G.roll_angle(landmarks(spark, sf_dir))
    lm = F.col("lm")
    return df.select(
        "video", "frame_idx",
        F.round(G.proxy_angle_deg(lm), 6).alias("proxy_deg"),
        F.round(G.knuckle_angle(lm), 8).alias("knuckle"),
        F.round("roll", 6).alias("roll"),
        G.handedness_from_wrist(lm).alias("hand"),
    )


@query(
    "pca_angle",
    with_ctes(
        "landmarks",
        body=_PTS
        + """
, k AS (SELECT video, frame_idx, p.x - i.x AS ax, p.y - i.y AS ay, r.x - i.x AS bx, r.y - i.y AS byy, p.x - m.x AS cx, p.y - m.y AS cy FROM pts)
, v AS (SELECT video, frame_idx, (ax/sqrt(ax*ax+ay*ay) + bx/sqrt(bx*bx+byy*byy) + cx/sqrt(cx*cx+cy*cy)) / 3 AS x,
   (ay/sqrt(ax*ax+ay*ay) + byy/sqrt(bx*bx+byy*byy) + cy/sqrt(cx*cx+cy*cy)) / 3 AS y FROM k)
, c AS (SELECT *, x - median(x) OVER (PARTITION BY video) AS qx, y - median(y) OVER (PARTITION BY video) AS qy FROM v)
, t AS (SELECT video, atan2(2 * sum(qx*qy), sum(qx*qx) - sum(qy*qy)) / 2 AS th FROM c GROUP BY video)
, e AS (SELECT video, cos(th) * CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END AS a1,
   sin(th) * CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END AS a2,
   -sin(th) * CASE WHEN abs(sin(th)) >= abs(cos(th)) THEN sign(-sin(th)) ELSE sign(cos(th)) END AS o1,
   cos(th) * CASE WHEN abs(sin(th)) >= abs(cos(th)) THEN sign(-sin(th)) ELSE sign(cos(th)) END AS o2 FROM t)
SELECT video, frame_idx, round(atan2(x*o1 + y*o2, x*a1 + y*a2), 7) AS angle FROM v JOIN e USING (video)""",
    ),
)
def pca_angle(spark, sf_dir):
    return _rounded(G.pca_angle(landmarks(spark, sf_dir)), ["video", "frame_idx"], 7, "angle")


@query(
    "visibility_gate",
    with_ctes(
        "landmarks",
        body=_PTS
        + """
, v AS (SELECT video, frame_idx, least(i.v, m.v, r.v, p.v) AS vis FROM pts)
, t AS (SELECT video, least(0.35, greatest(0.15, quantile_cont(vis, 0.2))) AS thr FROM v GROUP BY video)
SELECT video, frame_idx, round(vis, 8) AS vis FROM v JOIN t USING (video) WHERE vis >= thr""",
    ),
)
def visibility_gate(spark, sf_dir):
    kept = G.gate_by_visibility(landmarks(spark, sf_dir))
    return kept.select(
        "video", "frame_idx", F.round(G.min_mcp_visibility(F.col("lm")), 8).alias("vis")
    )


@query(
    "mcp_span_swing",
    with_ctes(
        "landmarks",
        body=_PTS
        + """
, s AS (SELECT video, sqrt((p.x-i.x)^2 + (p.y-i.y)^2) AS s, sqrt(((p.x-i.x)*640)^2 + ((p.y-i.y)*480)^2) AS px, w.x AS wx, w.y AS wy FROM pts)
SELECT video, round(median(s), 8) AS span, round(median(px), 6) AS span_px, round(sqrt(var_pop(wx) + var_pop(wy)) / median(s), 8) AS arm_swing FROM s GROUP BY video""",
    ),
)
def mcp_span_swing(spark, sf_dir):
    out = G.span_and_swing(landmarks(spark, sf_dir), 640, 480)
    return out.select(
        "video", F.round("span", 8).alias("span"), F.round("span_px", 6).alias("span_px"),
        F.round("arm_swing", 8).alias("arm_swing"),
    )


_BOX_SQL = """
, b AS (SELECT video, frame_idx, list_min(list_transform(lm, lambda q: q.x)) AS x0, list_max(list_transform(lm, lambda q: q.x)) AS x1,
  list_min(list_transform(lm, lambda q: q.y)) AS y0, list_max(list_transform(lm, lambda q: q.y)) AS y1, lm FROM landmarks)"""


@query(
    "bbox_stats",
    with_ctes(
        "landmarks",
        body=_BOX_SQL
        + """
SELECT video, frame_idx, greatest(0, CAST(trunc(x0*640 - (x1*640-x0*640)*0.15) AS INT)) AS x1, greatest(0, CAST(trunc(y0*480 - (y1*480-y0*480)*0.15) AS INT)) AS y1,
  least(640, CAST(trunc(x1*640 + (x1*640-x0*640)*0.15) AS INT)) AS x2, least(480, CAST(trunc(y1*480 + (y1*480-y0*480)*0.15) AS INT)) AS y2,
  CAST(trunc(greatest(0, x0*640 - (x1-x0)*640*0.3)) AS INT) AS rx1, CAST(trunc(least(640, x1*640 + (x1-x0)*640*0.3)) AS INT) AS rx2,
  round(greatest(0, y0 - 0.25), 8) AS ny1, round(least(1, y1 + 0.25), 8) AS ny2 FROM b""",
    ),
)
def bbox_stats(spark, sf_dir):
    lm = F.col("lm")
    box = G.pixel_box(lm, 640, 480)
    return landmarks(spark, sf_dir).select(
        "video", "frame_idx", *[box[k].alias(k) for k in ("x1", "y1", "x2", "y2")],
        G.refinement_box(lm, 640, 480)["x1"].alias("rx1"),
        G.refinement_box(lm, 640, 480)["x2"].alias("rx2"),
        F.round(G.redetection_box(lm)["y1"], 8).alias("ny1"),
        F.round(G.redetection_box(lm)["y2"], 8).alias("ny2"),
    )


@query(
    "rolling_median_reject",
    with_ctes(
        "landmarks",
        body=_PTS
        + f"""
, q AS (SELECT *, quantile_cont(i.x, 0.5) OVER z AS ix, quantile_cont(i.y, 0.5) OVER z AS iy, quantile_cont(w.x, 0.5) OVER z AS wx, quantile_cont(w.y, 0.5) OVER z AS wy
  FROM pts WINDOW z AS ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT video, frame_idx, round(CASE WHEN sqrt((i.x-ix)^2 + (i.y-iy)^2) > 0.06 THEN ix ELSE i.x END, 8) AS index_x,
  round(CASE WHEN sqrt((w.x-wx)^2 + (w.y-wy)^2) > 0.06 THEN wy ELSE w.y END, 8) AS wrist_y, round(lm[3].x, 8) AS other_x FROM q""",
    ),
)
def rolling_median_reject(spark, sf_dir):
    df = G.reject_outliers(landmarks(spark, sf_dir), FPS)
    lm = F.col("lm")
    return df.select(
        "video", "frame_idx",
        F.round(G.point(lm, G.INDEX)["x"], 8).alias("index_x"),
        F.round(G.point(lm, G.WRIST)["y"], 8).alias("wrist_y"),
        F.round(G.point(lm, 2)["x"], 8).alias("other_x"),
    )


_CONF_SQL = _PTS + f"""
, sp AS (SELECT video, greatest(1e-8, 0.05 * median(sqrt((p.x-i.x)^2 + (p.y-i.y)^2))) AS scale FROM pts GROUP BY video)
, md AS (SELECT *, count(*) OVER z AS n, """ + ", ".join(
    f"{n}.x - quantile_cont({n}.x, 0.5) OVER z AS {n}dx, {n}.y - quantile_cont({n}.y, 0.5) OVER z AS {n}dy" for n in "imrp"
) + f""" FROM pts WINDOW z AS ({W} RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
, cf AS (SELECT md.video, frame_idx, lm, """ + ", ".join(
    f"CASE WHEN n < 2 THEN 1 ELSE 1 / (1 + sqrt({n}dx^2 + {n}dy^2) / scale) END AS c{n}" for n in "imrp"
) + " FROM md JOIN sp USING (video))"


@query(
    "confidence_proxy",
    with_ctes(
        "landmarks",
        body=_CONF_SQL
        + " SELECT video, frame_idx, round(ci, 7) AS conf_index, round(cp, 7) AS conf_pinky, round(least(ci, cm, cr, cp), 7) AS conf_min FROM cf",
    ),
)
def confidence_proxy(spark, sf_dir):
    df = G.confidence_proxy(landmarks(spark, sf_dir))
    return _rounded(df, ["video", "frame_idx"], 7, "conf_index", "conf_pinky", "conf_min")


@query(
    "confidence_means",
    with_ctes(
        "landmarks",
        body=_CONF_SQL
        + """, u AS (SELECT *, CASE WHEN least(ci, cm, cr, cp) >= 0.5 THEN 1 ELSE 0 END AS used FROM cf)
SELECT video, round(avg(ci) FILTER (used = 1), 7) AS mean_conf_index, round(avg(cm) FILTER (used = 1), 7) AS mean_conf_middle,
 round(avg(cr) FILTER (used = 1), 7) AS mean_conf_ring, round(avg(cp) FILTER (used = 1), 7) AS mean_conf_pinky,
 round((avg(ci) FILTER (used = 1) + avg(cm) FILTER (used = 1) + avg(cr) FILTER (used = 1) + avg(cp) FILTER (used = 1)) / 4, 7) AS mean_conf_overall FROM u GROUP BY video""",
    ),
)
def confidence_means(spark, sf_dir):
    df = G.confidence_proxy(landmarks(spark, sf_dir)).withColumn(
        "used", F.when(F.col("conf_min") >= 0.5, 1.0).otherwise(0.0)
    )
    names = ["conf_index", "conf_middle", "conf_ring", "conf_pinky"]
    out = quality.confidence_means(df, names, "used", ["video"])
    return _rounded(out, ["video"], 7, *[f"mean_{n}" for n in names], "mean_conf_overall")


@query(
    "frame_filter",
    with_ctes(
        "landmarks",
        body=_CONF_SQL
        + """
, a AS (SELECT video, frame_idx, lm FROM cf WHERE least(ci, cm, cr, cp) >= 0.7
   AND len(list_filter(lm, lambda q: q.x < 0.02 OR q.x > 0.98 OR q.y < 0.02 OR q.y > 0.98)) = 0)
, nb AS (SELECT a.video, a.frame_idx, a.lm, b.lm AS o, b.frame_idx AS g FROM a LEFT JOIN a b ON a.video = b.video AND a.frame_idx <> b.frame_idx AND abs(a.frame_idx - b.frame_idx) <= 2)
, ex AS (SELECT video, frame_idx, g, unnest(range(1, 22)) AS k, lm, o FROM nb WHERE g IS NOT NULL)
, st AS (SELECT video, frame_idx, k, count(*) AS n, any_value(lm[k].x) AS x, any_value(lm[k].y) AS y, median(o[k].x) AS mx, median(o[k].y) AS my,
   greatest(0.005, stddev_pop(o[k].x)) AS sx, greatest(0.005, stddev_pop(o[k].y)) AS sy FROM ex GROUP BY video, frame_idx, k)
, bad AS (SELECT DISTINCT video, frame_idx FROM st JOIN (SELECT video, count(*) AS total FROM a GROUP BY video) USING (video)
   WHERE n >= 2 AND total > 10 AND (abs(x - mx) > 2 * sx OR abs(y - my) > 2 * sy))
SELECT video, frame_idx FROM a ANTI JOIN bad USING (video, frame_idx) WHERE
 (list_max(list_transform(lm, lambda q: q.x)) - list_min(list_transform(lm, lambda q: q.x))) * (list_max(list_transform(lm, lambda q: q.y)) - list_min(list_transform(lm, lambda q: q.y))) >= 0.01""",
    ),
)
def frame_filter(spark, sf_dir):
    return G.accept_frames(landmarks(spark, sf_dir)).select("video", "frame_idx")


@query(
    "label_to_text",
    with_ctes(
        "landmarks",
        body=_BOX_SQL
        + """
, u AS (SELECT video, frame_idx, list_transform([(x0+x1)/2, (y0+y1)/2, (x1-x0)*1.3, (y1-y0)*1.3, lm[1].x, lm[1].y, lm[6].x, lm[6].y, lm[10].x, lm[10].y, lm[14].x, lm[14].y, lm[18].x, lm[18].y],
   lambda q: format('{:.6f}', greatest(0.0, least(1.0, q)))) AS f FROM b)
SELECT video, frame_idx, '0 ' || f[1] || ' ' || f[2] || ' ' || f[3] || ' ' || f[4] || ' ' || f[5] || ' ' || f[6] || ' 2 ' || f[7] || ' ' || f[8] || ' 2 ' ||
  f[9] || ' ' || f[10] || ' 2 ' || f[11] || ' ' || f[12] || ' 2 ' || f[13] || ' ' || f[14] || ' 2' AS line FROM u""",
    ),
)
def label_to_text(spark, sf_dir):
    return landmarks(spark, sf_dir).select("video", "frame_idx", G.label_line(F.col("lm")).alias("line"))


@query(
    "landmark_overwrite",
    with_ctes(
        "landmarks",
        body="""
, l AS (SELECT *, video * 250 + frame_idx AS id FROM landmarks), o AS (SELECT id, lm[1].x + 0.01 AS x, (id * 37 % 100) / 100.0 AS conf FROM l WHERE id % 3 <> 1)
SELECT l.video, l.frame_idx, coalesce(conf > 0.3, false) AS refined, round(CASE WHEN conf > 0.3 THEN o.x ELSE l.lm[1].x END, 8) AS wrist_x FROM l LEFT JOIN o USING (id)""",
    ),
)
def landmark_overwrite(spark, sf_dir):
    track = landmarks(spark, sf_dir)
    number = F.col("video") * 250 + F.col("frame_idx")
    refined = track.filter(number % 3 != 1).select(
        "video", "frame_idx",
        F.transform(
            "lm",
            lambda p: F.struct((p["x"] + 0.01).alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["v"].alias("v")),
        ).alias("lm"),
        ((number * 37 % 100) / 100.0).alias("conf"),
    )
    out = G.overwrite_landmarks(track, refined, 0.30)
    return out.select("video", "frame_idx", "refined", F.round(G.point(F.col("lm"), 0)["x"], 8).alias("wrist_x"))


_TRIM_SQL = _PTS + f"""
, a AS (SELECT video, frame_idx, degrees(atan2(p.y - i.y, p.x - i.x)) AS ang FROM pts WHERE (video * 250 + frame_idx) % 9 <> 4)
, v AS (SELECT video, frame_idx, coalesce(abs(ang - lag(ang) OVER ({W})) / (frame_idx - lag(frame_idx) OVER ({W})), 0) * (1 + 30 * (frame_idx % 200 > 60)::INT) AS rate FROM a)"""


@query(
    "activity_sessions",
    with_ctes(
        "landmarks",
        body=_TRIM_SQL
        + f"""
, s AS (SELECT *, sum(rate) OVER ({W} RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25.0 AS sm FROM v)
, q AS (SELECT video, quantile_cont(sm, 0.75) AS ref FROM s GROUP BY video HAVING count(*) >= 10)
, act AS (SELECT s.video, frame_idx, coalesce(frame_idx - lag(frame_idx) OVER ({W}) > 62, true) AS fresh FROM s JOIN q USING (video) WHERE ref >= 1e-6 AND sm >= 0.15 * ref)
, seg AS (SELECT video, g, min(frame_idx) AS st, max(frame_idx) AS en FROM (SELECT *, sum(fresh::INT) OVER ({W}) AS g FROM act) GROUP BY video, g)
, best AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN en - st + 1 >= 100 THEN 0 ELSE 1 END, CASE WHEN en - st + 1 >= 100 THEN 0 ELSE st - en END, st) AS r FROM seg)
SELECT video, st AS ps_start, least(en, st + 249) AS ps_end FROM best WHERE r = 1""",
    ),
)
def activity_sessions(spark, sf_dir):
    number = F.col("video") * 250 + F.col("frame_idx")
    tracked = landmarks(spark, sf_dir).filter(number % 9 != 4).select(
        "video", "frame_idx", G.proxy_angle_deg(F.col("lm")).alias("ang")
    )
    w = S._w(["video"])
    rate = F.coalesce(
        F.abs(F.col("ang") - F.lag("ang").over(w)) / (F.col("frame_idx") - F.lag("frame_idx").over(w)), F.lit(0.0)
    )
    moving = tracked.withColumn(
        "rate", rate * F.when(F.col("frame_idx") % 200 > 60, 31).otherwise(1)
    )
    return S.activity_segment(moving, "rate", FPS)


@query(
    "appearance_metrics",
    with_ctes(
        "landmarks",
        body="""
, t AS (SELECT * FROM landmarks WHERE (video * 250 + frame_idx) % 9 <> 4 AND frame_idx > 11)
SELECT video, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS detected_total, max(frame_idx) - min(frame_idx) + 1 AS window_len,
 round(100.0 * count(*) / (max(frame_idx) - min(frame_idx) + 1), 6) AS adjusted_pct, round(100.0 * count(*) / 250, 6) AS non_adjusted_pct,
 round(sum(CAST(0.5 + label * 0.05 AS DOUBLE)), 6) AS conf_sum, round(avg(CAST(0.5 + label * 0.05 AS DOUBLE)), 8) AS avg_conf FROM t GROUP BY video""",
    ),
)
def appearance_metrics(spark, sf_dir):
    number = F.col("video") * 250 + F.col("frame_idx")
    track = landmarks(spark, sf_dir).filter((number % 9 != 4) & (F.col("frame_idx") > 11))
    scored = track.withColumn("score", F.lit(0.5) + F.col("label") * 0.05)
    out = tracking.appearance(scored, F.lit(250))
    digits = {"adjusted_pct": 6, "non_adjusted_pct": 6, "conf_sum": 6, "avg_conf": 8}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "frame_quality",
    with_ctes(
        "landmarks",
        body="""
, f AS (SELECT video, 100 + 500 * lm[1].z AS sharpness, 128 + 100 * lm[2].z AS luminance, 40 + 30 * lm[3].z AS contrast, abs(lm[4].z) AS saturation, abs(lm[5].z * 10) AS temporal_diff FROM landmarks)
SELECT video, round(median(sharpness), 7) AS sharpness_median, round(quantile_cont(sharpness, 0.1), 7) AS sharpness_q10, round(quantile_cont(sharpness, 0.25), 7) AS sharpness_q25,
 round(median(luminance), 7) AS luminance_median, round(avg(luminance), 7) AS luminance_mean, round(stddev_pop(luminance) / greatest(avg(luminance), 1e-6), 7) AS luminance_cv,
 round(median(contrast), 7) AS contrast_median, round(median(saturation), 7) AS saturation_median, round(median(temporal_diff), 7) AS temporal_diff_median,
 round(stddev_pop(temporal_diff) / greatest(avg(temporal_diff), 1e-6), 7) AS temporal_diff_cv, round(8.0 * 5000000 / (count(*) / 25.0 * 1000), 6) AS bitrate_kbps FROM f GROUP BY video""",
    ),
)
def frame_quality(spark, sf_dir):
    z = [G.point(F.col("lm"), i)["z"] for i in range(5)]
    metrics = landmarks(spark, sf_dir).select(
        "video",
        (100 + 500 * z[0]).alias("sharpness"),
        (128 + 100 * z[1]).alias("luminance"),
        (40 + 30 * z[2]).alias("contrast"),
        F.abs(z[3]).alias("saturation"),
        F.abs(z[4] * 10).alias("temporal_diff"),
    )
    out = quality.frame_quality(metrics, ["video"])
    sizes = metrics.groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    rate = quality.bitrate_kbps(F.lit(5_000_000), F.col("n"), F.lit(FPS))
    joined = out.join(sizes, "video").withColumn("bitrate_kbps", F.round(rate, 6)).drop("n")
    return joined.withColumns(
        {c: F.round(c, 7) for c in joined.columns if c not in ("video", "bitrate_kbps")}
    )


@query("track_association")
def track_association(spark, sf_dir):
    dets = detections(spark, sf_dir)
    tracked = tracking.associate(dets, FPS, "Left")
    return tracked.select("video", "frame_idx", "det_idx", "track")


_TOPK_SQL = """
WITH t AS (SELECT l_orderkey AS video, l_linenumber AS track, sum(l_extendedprice) / 1000 + l_linenumber / 1e6 AS rot, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT video, arg_max(track, rot) AS track, round(max(rot), 4) AS rot_total FROM t WHERE rot / n >= 20 GROUP BY video"""


@query("main_track_topk", _TOPK_SQL)
def main_track_topk(spark, sf_dir):
    # lines of an order as candidate tracks of a recording
    li = table(spark, sf_dir, "lineitem")
    rotations = li.groupBy(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("track")).agg(
        (F.sum("l_extendedprice") / 1000).alias("_r"), F.count(F.lit(1)).alias("det_count")
    ).select(
        "video", "track", "det_count",
        (F.col("_r") + F.col("track") / 1e6).alias("rot_total"),
        F.lit(0.0).alias("rot_amp"), F.lit(1.0).alias("avg_conf"), F.lit("Left").alias("hand_label"),
    )
    out = tracking.main_track(rotations, FPS, settings=replace(DEFAULTS, rot_avg_thresh=20.0))
    return out.select("video", "track", F.round("rot_total", 4).alias("rot_total"))


@query("main_track")
def main_track(spark, sf_dir):
    tracked = tracking.associate(detections(spark, sf_dir), FPS)
    return tracking.main_track(tracking.rotation(tracked), FPS)


@query(
    "gap_fill",
    with_ctes(
        "landmarks",
        body="""
, d AS (SELECT video, frame_idx // 2 AS f, frame_idx % 2 AS det_idx, CASE WHEN label % 2 = frame_idx % 2 THEN 'Left' ELSE 'Right' END AS hand,
   lm[1].x + (frame_idx % 2) * 0.35 AS x, lm[1].y AS y FROM landmarks)
, t AS (SELECT * FROM d WHERE det_idx = 0 AND f % 6 <> 2)
, o AS (SELECT DISTINCT video, f FROM d WHERE (video, f) NOT IN (SELECT video, f FROM t))
, n AS (SELECT o.video, o.f, arg_min({'x': t.x, 'y': t.y}, abs(t.f - o.f) * 1000 + t.f) AS ref FROM o JOIN t ON o.video = t.video AND abs(t.f - o.f) < 3 GROUP BY ALL)
, c AS (SELECT d.video, d.f, d.det_idx, sqrt((d.x - ref.x)^2 + (d.y - ref.y)^2) * CASE WHEN hand <> 'Left' THEN 1.25 ELSE 1.0 END AS dist FROM d JOIN n USING (video, f))
SELECT video, f AS frame_idx, arg_min(det_idx, dist) AS det_idx, round(min(dist), 8) AS fill_dist FROM c GROUP BY video, f HAVING min(dist) <= 0.12""",
    ),
)
def gap_fill(spark, sf_dir):
    dets = detections(spark, sf_dir)
    track = dets.filter((F.col("det_idx") == 0) & (F.col("frame_idx") % 6 != 2))
    filled = tracking.fill_gaps(track, dets, FPS, "Left")
    return filled.select("video", "frame_idx", "det_idx", F.round("fill_dist", 8).alias("fill_dist"))


@query("recording_features")
def recording_features(spark, sf_dir):
    return K.recording_features(frames(spark, sf_dir), "seen", FPS)


@query("clean_signals")
def clean_signals(spark, sf_dir):
    packed = K.prepare(frames(spark, sf_dir), "seen", FPS)
    return packed.select("video", "clip", "band", "low", "band_period", "low_period")


@query("prominent_half_cycles")
def prominent_half_cycles(spark, sf_dir):
    packed = K.prepare(frames(spark, sf_dir), "seen", FPS)
    return K.half_cycles(packed, "band", "band_period", None, FPS)


@query(
    "acf_strength",
    with_ctes(
        "frames",
        body="""
, c AS (SELECT video, clip, frame_idx, value - avg(value) OVER (PARTITION BY video, clip) AS x, count(*) OVER (PARTITION BY video, clip) AS n FROM frames)
, l AS (SELECT a.video, a.clip, b.frame_idx - a.frame_idx AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.video = b.video AND a.clip = b.clip
   AND b.frame_idx - a.frame_idx BETWEEN 6 AND 83 AND b.frame_idx - a.frame_idx <= a.n // 2 AND a.n >= 30 GROUP BY ALL)
, v AS (SELECT video, clip, sum(x * x) AS v FROM c GROUP BY ALL)
SELECT v.video, v.clip, round(coalesce(greatest(0, least(1, max(s) / any_value(v))), 0), 8) AS acf FROM v LEFT JOIN l USING (video, clip) GROUP BY ALL""",
    ),
)
def acf_strength(spark, sf_dir):
    packed = K.pack_signal(frames(spark, sf_dir), ["value"])
    return packed.select("video", "clip", F.round(F.get(K.periodicity(F.col("value"), FPS), F.lit(1)), 8).alias("acf"))


@query(
    "spectral_share",
    with_ctes(
        "frames",
        body="""
, c AS (SELECT video, clip, frame_idx, value - avg(value) OVER (PARTITION BY video, clip) AS x, count(*) OVER (PARTITION BY video, clip) AS n FROM frames)
, k AS (SELECT video, clip, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT video, clip, n FROM c))
, d AS (SELECT k.video, k.clip, k.k, k.k * 25.0 / k.n AS f, sum(x * cos(2 * pi() * k.k * frame_idx / k.n))^2 + sum(x * sin(2 * pi() * k.k * frame_idx / k.n))^2 AS p
   FROM k JOIN c USING (video, clip) WHERE k.k * 25.0 / k.n BETWEEN 0.3 AND 4.0 GROUP BY k.video, k.clip, k.k, k.n)
, m AS (SELECT video, clip, arg_max(f, p) AS peak, sum(p) AS total FROM d GROUP BY ALL)
SELECT m.video, m.clip, round(sum(p) / any_value(total), 8) AS share FROM m JOIN d USING (video, clip) WHERE f BETWEEN peak - 0.3 AND peak + 0.3 GROUP BY m.video, m.clip""",
    ),
)
def spectral_share(spark, sf_dir):
    packed = K.pack_signal(frames(spark, sf_dir), ["value"])
    return packed.select(
        "video", "clip", F.round(F.get(K.periodicity(F.col("value"), FPS), F.lit(0)), 8).alias("share")
    )


@query(
    "sample_entropy",
    with_ctes(
        "frames",
        body=f"""
, r AS (SELECT video, clip, 0.2 * stddev_samp(value) AS r, count(*) AS n FROM frames GROUP BY ALL)
, t AS (SELECT video, clip, frame_idx, value AS a, lead(value) OVER (PARTITION BY video, clip ORDER BY frame_idx) AS b, lead(value, 2) OVER (PARTITION BY video, clip ORDER BY frame_idx) AS c FROM frames)
, q AS (SELECT x.video, x.clip, count(*) FILTER (y.frame_idx < n - 2 AND abs(x.a - y.a) < r AND abs(x.b - y.b) < r) AS m2,
   count(*) FILTER (y.frame_idx < n - 3 AND abs(x.a - y.a) < r AND abs(x.b - y.b) < r AND abs(x.c - y.c) < r) AS m3
   FROM t x JOIN t y ON x.video = y.video AND x.clip = y.clip AND x.frame_idx < y.frame_idx JOIN r ON r.video = x.video AND r.clip = x.clip WHERE n >= 7 GROUP BY ALL)
SELECT r.video, r.clip, round(CASE WHEN m2 > 0 THEN CASE WHEN m3 = 0 THEN ln(m2) ELSE -ln(m3 / m2) END END, 8) AS sampen FROM r LEFT JOIN q USING (video, clip)""",
    ),
)
def sample_entropy(spark, sf_dir):
    packed = K.pack_signal(frames(spark, sf_dir), ["value"])
    return packed.select("video", "clip", F.round(K.sample_entropy(F.col("value")), 8).alias("sampen"))


@query(
    "signal_quality",
    with_ctes(
        "cyclefeat",
        body="""
, s AS (SELECT video, mean_amplitude / 50 AS a, peak_velocity / 100 AS b, amplitude_cv / 100 AS c, 1 - pause_time_ratio AS d, rhythm_cv / 60 AS e,
  1 / (1 + exp(-0.7 * (total_cycles - 3.0))) AS f FROM cyclefeat)
SELECT video, round((2 * greatest(0, least(1, a)) + 2 * greatest(0, least(1, b)) + 1.5 * greatest(0, least(1, c)) + greatest(0, least(1, d))
  + greatest(0, least(1, e)) + 1.5 * greatest(0, least(1, f))) / 9, 9) AS signal_quality FROM s WHERE e IS NOT NULL""",
    ),
)
def signal_quality(spark, sf_dir):
    f = cycle_features(spark, sf_dir)
    subs = f.filter(F.col("rhythm_cv").isNotNull()).select(
        "video",
        (F.col("mean_amplitude") / 50).alias("sq_spectral_concentration"),
        (F.col("peak_velocity") / 100).alias("sq_autocorr_strength"),
        (F.col("amplitude_cv") / 100).alias("sq_cycle_regularity"),
        (1 - F.col("pause_time_ratio")).alias("sq_signal_coverage"),
        (F.col("rhythm_cv") / 60).alias("sq_freq_plausibility"),
        (1.0 / (1.0 + F.exp(-0.7 * (F.col("total_cycles") - 3.0)))).alias("sq_cycle_yield"),
    )
    return subs.select("video", F.round(K.signal_quality(), 9).alias("signal_quality"))


@query(
    "dataset_quality",
    with_ctes(
        "logs",
        "cyclefeat",
        "featlog",
        body="""
, d AS (SELECT mean_amplitude AS a, quality * 100 AS p, pause_time_ratio AS s, arm_swing AS c, amplitude_cv / 100 AS y, peak_velocity / 25 AS f,
   CASE WHEN total_cycles >= 3 THEN pause_time_ratio END AS nf FROM featlog)
, j AS (SELECT count(*) AS n_total, count(a) AS n_with_features, count(*) FILTER (a IS NOT NULL AND nf IS NOT NULL) AS n_signal_evaluated, count(a) / count(*) AS yield_rate, avg(p) / 100 AS coverage,
   avg(s) FILTER (nf IS NOT NULL) AS spectral_concentration, avg(c) FILTER (nf IS NOT NULL) AS autocorr_strength, avg(y) FILTER (nf IS NOT NULL) AS cycle_shape_consistency,
   count(*) FILTER (nf IS NOT NULL AND f BETWEEN 0.3 AND 4) / count(*) FILTER (nf IS NOT NULL) AS freq_physio_rate, 1 - avg(nf) AS low_nan_frac FROM d)
SELECT n_total, n_with_features, n_signal_evaluated, round(yield_rate, 9) AS yield_rate, round(coverage, 9) AS coverage, round(spectral_concentration, 9) AS spectral_concentration,
  round(autocorr_strength, 9) AS autocorr_strength, round(cycle_shape_consistency, 9) AS cycle_shape_consistency, round(freq_physio_rate, 9) AS freq_physio_rate, round(low_nan_frac, 9) AS low_nan_frac,
  round((1.5 * yield_rate + coverage + 2 * spectral_concentration + 2 * autocorr_strength + 1.5 * cycle_shape_consistency + freq_physio_rate + low_nan_frac) / 10, 9) AS signal_quality_score FROM j""",
    ),
)
def dataset_quality(spark, sf_dir):
    f = feature_log(spark, sf_dir)
    logs = f.select(
        "mean_amplitude",
        (F.col("quality") * 100).alias("adjusted_pct"),
        F.col("pause_time_ratio").alias("spectral_concentration"),
        F.col("arm_swing").alias("autocorr_strength"),
        (F.col("amplitude_cv") / 100).alias("cycle_shape_consistency"),
        (F.col("peak_velocity") / 25).alias("mean_frequency"),
        F.when(F.col("total_cycles") >= 3, F.col("pause_time_ratio")).alias("nan_fraction"),
    )
    out = quality.dataset_quality(logs)
    counts = ("n_total", "n_with_features", "n_signal_evaluated")
    return out.select(*counts, *[F.round(c, 9).alias(c) for c in out.columns if c not in counts])


@query(
    "ssl_export",
    with_ctes(
        "frames",
        body="""
, p AS (SELECT video, clip, list(value ORDER BY frame_idx) AS x, avg(value) AS mu, stddev_pop(value) AS sd FROM frames GROUP BY ALL)
SELECT video, clip, len(list_transform(range(1024), lambda i: CASE WHEN i < len(x) THEN (x[i + 1] - mu) / sd ELSE 0.0 END)) AS length,
 round(list_sum(list_transform(range(1024), lambda i: CASE WHEN i < len(x) THEN (x[i + 1] - mu) / sd * (i + 1) ELSE 0.0 END)), 6) AS checksum FROM p""",
    ),
)
def ssl_export(spark, sf_dir):
    packed = K.pack_signal(frames(spark, sf_dir), ["value"])
    out = packed.select("video", "clip", fixed_length(F.col("value")).alias("x"))
    weighted = F.transform("x", lambda v, i: v * (i + 1))
    return out.select(
        "video", "clip", F.size("x").alias("length"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v), 6).alias("checksum"),
    )
