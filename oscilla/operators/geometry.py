"""Landmark geometry: angles, spans, boxes, visibility and per-landmark cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.config import DEFAULTS, Settings
from oscilla.operators.sequence import array_median

# Landmark numbers of the 21-point hand model.
WRIST, INDEX, MIDDLE, RING, PINKY = 0, 5, 9, 13, 17
MCPS = (INDEX, MIDDLE, RING, PINKY)
KEY_POINTS = (WRIST, *MCPS)
KNUCKLE_PAIRS = ((INDEX, PINKY), (INDEX, RING), (MIDDLE, PINKY))
LABEL_POINTS = (WRIST, INDEX, MIDDLE, RING, PINKY)

Vector = tuple[Column, Column, Column]


def point(lm: Column, i: int) -> Column:
    return F.get(lm, F.lit(i))


def with_visibility(lm: Column) -> Column:
    """Landmarks with a missing visibility set to fully visible."""
    return F.transform(
        lm,
        lambda p: F.struct(
            p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"),
            F.coalesce(p["v"], F.lit(1.0)).alias("v"),
        ),
    )


def min_mcp_visibility(lm: Column) -> Column:
    return F.least(*[point(lm, i)["v"] for i in MCPS])


def proxy_angle_deg(lm: Column) -> Column:
    a, b = point(lm, INDEX), point(lm, PINKY)
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def _knuckle_vector(lm: Column) -> tuple[Column, Column, Column]:
    """Sum of unit knuckle-line vectors and how many of them are defined."""
    sx, sy, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for a, b in KNUCKLE_PAIRS:
        dx = point(lm, b)["x"] - point(lm, a)["x"]
        dy = point(lm, b)["y"] - point(lm, a)["y"]
        mag = F.sqrt(dx * dx + dy * dy)
        ok = mag > 1e-9
        sx = sx + F.when(ok, dx / F.nullif(mag, F.lit(0.0))).otherwise(0.0)
        sy = sy + F.when(ok, dy / F.nullif(mag, F.lit(0.0))).otherwise(0.0)
        n = n + F.when(ok, 1).otherwise(0)
    return sx, sy, n


def knuckle_angle(lm: Column) -> Column:
    """Circular mean of the knuckle-line directions, the plain index-to-pinky line if none is defined."""
    sx, sy, n = _knuckle_vector(lm)
    a, b = point(lm, INDEX), point(lm, PINKY)
    return F.when(n > 0, F.atan2(sy, sx)).otherwise(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def _minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> Vector:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def _as_struct(v: Vector) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(v, "xyz", strict=True)])


def _vec(name: str) -> Vector:
    return tuple(F.col(f"{name}.{axis}") for axis in "xyz")


def _unit(name: str) -> Column:
    """Unit vector of a struct column, NULL when it is degenerate."""
    v = _vec(name)
    length = F.sqrt(_dot(v, v))
    return F.when(length >= 1e-9, _as_struct(tuple(c / length for c in v)))


def roll_angle(df: DataFrame, lm: str = "lm", out: str = "roll") -> DataFrame:
    """Palm roll about the wrist-to-middle axis; NULL for a degenerate hand.

    Staged as columns, so no vector is expanded more than once in the plan.
    """

    def xyz(i: int) -> Vector:
        return tuple(point(F.col(lm), i)[axis] for axis in "xyz")

    w = xyz(WRIST)
    staged = df.withColumns(
        {
            "_m": _as_struct(_minus(xyz(MIDDLE), w)),
            "_i": _as_struct(_minus(xyz(INDEX), w)),
            "_k": _as_struct(_minus(xyz(PINKY), w)),
        }
    )
    staged = staged.withColumn("_n", _as_struct(_cross(_vec("_i"), _vec("_k"))))
    staged = staged.withColumns({c: _unit(c) for c in ("_m", "_i", "_n")})
    along = _dot(_vec("_i"), _vec("_m"))
    staged = staged.withColumn(
        "_b1", _as_struct(tuple(d - along * u for d, u in zip(_vec("_i"), _vec("_m"), strict=True)))
    )
    staged = staged.withColumn("_b1", _unit("_b1"))
    staged = staged.withColumn("_b2", _as_struct(_cross(_vec("_m"), _vec("_b1"))))
    staged = staged.withColumn("_b2", _unit("_b2"))
    angle = F.atan2(_dot(_vec("_n"), _vec("_b2")), _dot(_vec("_n"), _vec("_b1")))
    return staged.withColumn(out, angle).drop("_m", "_i", "_k", "_n", "_b1", "_b2")


def gate_by_visibility(
    df: DataFrame, lm: str = "lm", keys: Sequence[str] = ("video",), settings: Settings = DEFAULTS
) -> DataFrame:
    """Drop frames whose weakest knuckle is below the recording's adaptive threshold."""
    staged = df.withColumn("_vis", min_mcp_visibility(F.col(lm)))
    low = F.percentile("_vis", settings.visibility_percentile / 100.0).over(Window.partitionBy(*keys))
    threshold = F.least(
        F.lit(settings.visibility_threshold), F.greatest(F.lit(settings.visibility_floor), low)
    )
    return staged.withColumn("_thr", threshold).filter(F.col("_vis") >= F.col("_thr")).drop("_vis", "_thr")


def pca_angle(
    df: DataFrame,
    lm: str = "lm",
    out: str = "angle",
    keys: Sequence[str] = ("video",),
) -> DataFrame:
    """Knuckle direction in the principal frame of its recording; below ten frames the plain angle.

    The principal axis of a 2 x 2 scatter matrix has a closed form.  Axis signs are fixed by making
    the larger component positive.
    """
    sx, sy, n = _knuckle_vector(F.col(lm))
    whole = Window.partitionBy(*keys)
    vectors = df.withColumns({"_n": n, "_x": sx / F.nullif(n, F.lit(0)), "_y": sy / F.nullif(n, F.lit(0))})
    centred = vectors.filter(F.col("_n") > 0).withColumns(
        {
            "_cx": F.col("_x") - F.percentile("_x", 0.5).over(whole),
            "_cy": F.col("_y") - F.percentile("_y", 0.5).over(whole),
            "_frames": F.count(F.lit(1)).over(whole),
        }
    )
    sums = centred.withColumns(
        {
            "_sxx": F.sum(F.col("_cx") * F.col("_cx")).over(whole),
            "_sxy": F.sum(F.col("_cx") * F.col("_cy")).over(whole),
            "_syy": F.sum(F.col("_cy") * F.col("_cy")).over(whole),
        }
    )
    theta = F.atan2(2.0 * F.col("_sxy"), F.col("_sxx") - F.col("_syy")) / 2.0
    framed = sums.withColumns({"_c": F.cos(theta), "_s": F.sin(theta)})

    def oriented(a: Column, b: Column) -> tuple[Column, Column]:
        flip = F.when(F.abs(a) >= F.abs(b), F.signum(a)).otherwise(F.signum(b))
        return a * flip, b * flip

    e1 = oriented(F.col("_c"), F.col("_s"))
    e2 = oriented(-F.col("_s"), F.col("_c"))
    mag = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    projected = F.atan2(
        F.col("_x") * e2[0] + F.col("_y") * e2[1], F.col("_x") * e1[0] + F.col("_y") * e1[1]
    )
    angle = F.when(F.col("_frames") < 10, F.atan2("_y", "_x")).otherwise(F.when(mag >= 1e-9, projected))
    return framed.withColumn(out, angle).drop(
        "_n", "_x", "_y", "_cx", "_cy", "_frames", "_sxx", "_sxy", "_syy", "_c", "_s"
    )


# spans and boxes


def mcp_span(lm: Column, width: float = 1.0, height: float = 1.0) -> Column:
    a, b = point(lm, INDEX), point(lm, PINKY)
    dx, dy = (b["x"] - a["x"]) * width, (b["y"] - a["y"]) * height
    return F.sqrt(dx * dx + dy * dy)


def span_and_swing(
    df: DataFrame, width: float, height: float, lm: str = "lm", keys: Sequence[str] = ("video",)
) -> DataFrame:
    """Median knuckle span (normalised and in pixels) and arm swing per recording."""
    wrist = point(F.col(lm), WRIST)
    staged = df.select(
        *keys,
        F.nullif(mcp_span(F.col(lm)), F.lit(0.0)).alias("_s"),
        F.nullif(mcp_span(F.col(lm), width, height), F.lit(0.0)).alias("_p"),
        wrist["x"].alias("_wx"),
        wrist["y"].alias("_wy"),
    )
    s = F.when(F.col("_s") > 1e-6, F.col("_s"))
    p = F.when(F.col("_p") > 1e-3, F.col("_p"))
    agg = staged.groupBy(*keys).agg(
        F.when(F.count(s) >= 5, F.percentile(s, F.lit(0.5))).alias("span"),
        F.when(F.count(p) >= 5, F.percentile(p, F.lit(0.5))).alias("span_px"),
        F.when(
            F.count("_wx") >= 5, F.sqrt(F.var_pop("_wx") + F.var_pop("_wy"))
        ).alias("_rms"),
    )
    swing = F.when(F.col("span") > 1e-6, F.col("_rms") / F.nullif(F.col("span"), F.lit(0.0))).otherwise(
        F.col("_rms")
    )
    return agg.withColumn("arm_swing", swing).drop("_rms")


def _extent(lm: Column, axis: str) -> tuple[Column, Column]:
    values = F.transform(lm, lambda p: p[axis])
    return F.array_min(values), F.array_max(values)


def pixel_box(lm: Column, width: int, height: int, padding: float = 0.15) -> dict[str, Column]:
    """Tight box padded by a share of its size, truncated to pixels, clipped to the frame."""
    out = {}
    for axis, size, names in (("x", width, ("x1", "x2")), ("y", height, ("y1", "y2"))):
        lo, hi = _extent(lm, axis)
        lo, hi = lo * size, hi * size
        pad = (hi - lo) * padding
        out[names[0]] = F.greatest(F.lit(0), (lo - pad).cast("int"))
        out[names[1]] = F.least(F.lit(size), (hi + pad).cast("int"))
    return out


def _padded_extent(lm: Column, axis: str, size: float, padding: float) -> tuple[Column, Column]:
    lo, hi = _extent(lm, axis)
    pad = (hi - lo) * size * padding
    return F.greatest(F.lit(0.0), lo * size - pad), F.least(F.lit(float(size)), hi * size + pad)


def refinement_box(lm: Column, width: int, height: int, padding: float = 0.30) -> Column:
    """Wider box for a refinement model, NULL when it is under ten pixels."""
    x1, x2 = _padded_extent(lm, "x", width, padding)
    y1, y2 = _padded_extent(lm, "y", height, padding)
    box = F.struct(*[c.cast("int").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    return F.when((x2 - x1 >= 10) & (y2 - y1 >= 10), box)


def redetection_box(lm: Column, padding: float = 0.25) -> Column:
    """Normalised search region around a hand, NULL when it is under 5 % of the frame."""
    out = {}
    for axis in ("x", "y"):
        lo, hi = _extent(lm, axis)
        out[axis] = (F.greatest(F.lit(0.0), lo - padding), F.least(F.lit(1.0), hi + padding))
    (x1, x2), (y1, y2) = out["x"], out["y"]
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 - x1 >= 0.05) & (y2 - y1 >= 0.05), box)


def label_line(lm: Column, padding: float = DEFAULTS.label_padding) -> Column:
    """One pose-label text line: class, padded box, then the labelled key points."""

    def unit(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    numbers = []
    sizes = []
    for axis in ("x", "y"):
        lo, hi = _extent(lm, axis)
        numbers.append(unit((lo + hi) / 2.0))
        sizes.append(unit((hi - lo) * (1.0 + 2.0 * padding)))
    box = F.format_string("0 %.6f %.6f %.6f %.6f", *numbers, *sizes)
    points = [
        F.format_string("%.6f %.6f 2", unit(point(lm, i)["x"]), unit(point(lm, i)["y"]))
        for i in LABEL_POINTS
    ]
    return F.concat_ws(" ", box, *points)


def handedness_from_wrist(lm: Column) -> Column:
    return F.when(point(lm, WRIST)["x"] > 0.5, "Left").otherwise("Right")


def expected_confidence(categories: Column, expected: str | None) -> Column:
    """Score of the expected label, else of the top category, else 0."""
    top = F.try_element_at(categories, F.lit(1))["score"]
    if expected is None:
        return F.coalesce(top, F.lit(0.0))
    named = F.try_element_at(F.filter(categories, lambda c: c["label"] == expected), F.lit(1))["score"]
    return F.coalesce(named, top, F.lit(0.0))


# cleaning


def reject_outliers(
    df: DataFrame,
    fps: float,
    lm: str = "lm",
    keys: Sequence[str] = ("video",),
    idx: str = "frame_idx",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Replace key points far from their median over the neighbouring detected frames."""
    window = max(3, round(settings.outlier_window * max(1.0, fps) / settings.base_fps))
    half = window // 2
    order = Window.partitionBy(*keys).orderBy(idx)
    span = order.rowsBetween(-half, half)
    staged = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    staged = staged.withColumns(
        {
            f"_{axis}{i}": F.percentile(point(F.col(lm), i)[axis], 0.5).over(span)
            for i in KEY_POINTS
            for axis in "xy"
        }
    )

    def replaced(p: Column, i: Column) -> Column:
        out_x, out_y = p["x"], p["y"]
        for k in KEY_POINTS:
            mx, my = F.col(f"_x{k}"), F.col(f"_y{k}")
            dx, dy = p["x"] - mx, p["y"] - my
            far = (i == k) & (F.sqrt(dx * dx + dy * dy) > settings.outlier_thresh)
            out_x = F.when(far, mx).otherwise(out_x)
            out_y = F.when(far, my).otherwise(out_y)
        return F.struct(out_x.alias("x"), out_y.alias("y"), p["z"].alias("z"), p["v"].alias("v"))

    cleaned = F.when(F.col("_n") < window, F.col(lm)).otherwise(F.transform(lm, replaced))
    return staged.withColumn(lm, cleaned).drop(
        "_n", *[f"_{axis}{i}" for i in KEY_POINTS for axis in "xy"]
    )


def confidence_proxy(
    df: DataFrame,
    lm: str = "lm",
    keys: Sequence[str] = ("video",),
    idx: str = "frame_idx",
    half: int = 2,
) -> DataFrame:
    """Stability of each knuckle against its rolling median, in (0, 1], and their minimum."""
    near = Window.partitionBy(*keys).orderBy(idx).rangeBetween(-half, half)
    scale = F.greatest(F.lit(1e-8), 0.05 * F.percentile("_span", 0.5).over(Window.partitionBy(*keys)))
    staged = df.withColumn("_span", mcp_span(F.col(lm)))
    staged = staged.withColumns({"_scale": scale, "_n": F.count(F.lit(1)).over(near)})
    staged = staged.withColumns(
        {
            f"_{axis}{i}": point(F.col(lm), i)[axis] - F.percentile(point(F.col(lm), i)[axis], 0.5).over(near)
            for i in MCPS
            for axis in "xy"
        }
    )
    names = {INDEX: "conf_index", MIDDLE: "conf_middle", RING: "conf_ring", PINKY: "conf_pinky"}
    out = staged.withColumns(
        {
            n: F.when(F.col("_n") < 2, 1.0).otherwise(
                1.0
                / (
                    1.0
                    + F.sqrt(F.col(f"_x{i}") * F.col(f"_x{i}") + F.col(f"_y{i}") * F.col(f"_y{i}"))
                    / F.col("_scale")
                )
            )
            for i, n in names.items()
        }
    )
    return out.withColumn("conf_min", F.least(*names.values())).drop(
        "_span", "_scale", "_n", *[f"_{axis}{i}" for i in MCPS for axis in "xy"]
    )


def accept_frames(
    df: DataFrame,
    lm: str = "lm",
    keys: Sequence[str] = ("video",),
    idx: str = "frame_idx",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Frames good enough to train on: confident, inside the frame, steady and large enough."""
    confident = confidence_proxy(df, lm, keys, idx).filter(F.col("conf_min") >= settings.min_mcp_conf)
    m = settings.frame_margin
    inside = F.forall(
        lm, lambda p: (p["x"] >= m) & (p["x"] <= 1.0 - m) & (p["y"] >= m) & (p["y"] <= 1.0 - m)
    )
    kept = confident.filter(inside)
    near = Window.partitionBy(*keys).orderBy(idx).rangeBetween(-2, 2)
    staged = kept.withColumns(
        {
            "_total": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "_near": F.collect_list(F.struct(F.col(idx).alias("f"), F.col(lm).alias("p"))).over(near),
        }
    )
    staged = staged.withColumn("_near", F.filter("_near", lambda s: s["f"] != F.col(idx)))

    def off(axis: str) -> Column:
        def test(i: Column) -> Column:
            values = F.transform("_near", lambda s: F.get(s["p"], i)[axis])
            n = F.size("_near")
            mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
            var = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
            gap = F.abs(F.get(lm, i)[axis] - array_median(values))
            return gap > 2.0 * F.greatest(F.sqrt(var), F.lit(0.005))

        return F.exists(F.sequence(F.lit(0), F.size(lm) - 1), test)

    judged = (F.col("_total") > 10) & (F.size("_near") >= 2)
    unsteady = judged & (off("x") | off("y"))
    steady = staged.filter(~F.coalesce(unsteady, F.lit(False)))
    (x0, x1), (y0, y1) = _extent(F.col(lm), "x"), _extent(F.col(lm), "y")
    large = (x1 - x0) * (y1 - y0) >= settings.min_bbox_share
    return steady.filter(large).drop("_total", "_near")


def overwrite_landmarks(
    track: DataFrame,
    refined: DataFrame,
    min_conf: float,
    keys: Sequence[str] = ("video", "frame_idx"),
    lm: str = "lm",
) -> DataFrame:
    """Take the refined landmarks of a frame where their confidence exceeds the limit."""
    other = refined.select(*keys, F.col(lm).alias("_lm"), F.col("conf").alias("_conf"))
    joined = track.join(other, list(keys), "left")
    better = F.coalesce(F.col("_conf") > min_conf, F.lit(False))
    return joined.withColumns(
        {lm: F.when(better, F.col("_lm")).otherwise(F.col(lm)), "refined": better}
    ).drop("_lm", "_conf")
