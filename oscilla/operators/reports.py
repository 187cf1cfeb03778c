"""The two end-to-end jobs: detections to a tracking log, and a tracking log to cohort tables.

Both are compositions of the operators in this package.  Nothing is collected: every step hands a
DataFrame on, and what several steps read is written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.config import DEFAULTS, Settings
from oscilla.functions import normalize as N
from oscilla.operators import cohort, paired, stats, tracking
from oscilla.operators import report_steps as steps
from oscilla.operators import geometry as G
from oscilla.operators import kinematics as K
from oscilla.operators import sequence as S
from oscilla.operators.learn import pca_varimax
from oscilla.session import durable


def smooth_key_points(track: DataFrame, window: int, keys: Sequence[str] = ("video",)) -> DataFrame:
    """Moving average of the key points over the neighbouring frames that exist."""
    flat = track.withColumns(
        {f"_{a}{i}": G.point(F.col("lm"), i)[a] for i in G.KEY_POINTS for a in "xyz"}
    )
    names = [f"_{a}{i}" for i in G.KEY_POINTS for a in "xyz"]
    smooth = S.moving_average(flat, names, window, keys)

    def rebuilt(p, i):
        parts = {a: p[a] for a in "xyz"}
        for k in G.KEY_POINTS:
            for a in "xyz":
                parts[a] = F.when(i == k, F.col(f"_{a}{k}_smooth")).otherwise(parts[a])
        return F.struct(*[parts[a].alias(a) for a in "xyz"], p["v"].alias("v"))

    return smooth.withColumn("lm", F.transform("lm", rebuilt)).drop(
        *names, *[f"{n}_smooth" for n in names]
    )


def angle_signal(track: DataFrame, fps: float, settings: Settings = DEFAULTS) -> DataFrame:
    """Unwrapped movement angle in degrees per visible frame, with the wrist depth beside it."""
    visible = G.gate_by_visibility(G.roll_angle(track), settings=settings)
    raw = G.pca_angle(visible).withColumn("clip", F.lit(0).cast("long"))
    steady = S.reject_spikes(raw, "angle", "_steady", fps, settings=settings)
    turned = S.unwrap(steady, "_steady", "_turned", axial=True)
    return turned.select(
        "video",
        "clip",
        "frame_idx",
        F.degrees("_turned").alias("angle_deg"),
        G.point(F.col("lm"), G.WRIST)["z"].alias("wrist_z"),
    )


def recording_log(
    detections: DataFrame,
    videos: DataFrame,
    fps: float,
    expected: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One log row per recording from its per-frame detections.

    ``videos`` has ``video``, ``total_frames``, ``width`` and ``height``.  Recordings without a
    rotating track stay in the log with NULL features, so a resumed run does not repeat them.
    """
    tracked = durable(tracking.associate(detections, fps, expected, settings=settings))
    chosen = tracking.main_track(
        tracking.rotation(tracked), fps, expected is not None, settings=settings
    )
    found = tracked.join(chosen.select("video", "track"), ["video", "track"], "left_semi")
    visible = found.withColumn("lm", G.with_visibility(F.col("lm")))
    smooth = smooth_key_points(visible, settings.smooth_window)
    cleaned = durable(G.reject_outliers(smooth, fps, settings=settings))

    order = S._w(["video"])
    ang = G.proxy_angle_deg(F.col("lm"))
    moving = cleaned.select("video", "frame_idx", ang.alias("_a")).withColumn(
        "rate",
        F.coalesce(
            F.abs(F.col("_a") - F.lag("_a").over(order))
            / (F.col("frame_idx") - F.lag("frame_idx").over(order)),
            F.lit(0.0),
        ),
    )
    window = S.activity_segment(moving, "rate", fps, settings=settings)
    bounds = cleaned.groupBy("video").agg(F.min("frame_idx").alias("_f"), F.max("frame_idx").alias("_l"))
    limits = bounds.join(window, "video", "left").select(
        "video",
        F.coalesce("ps_start", "_f").alias("ps_start"),
        F.coalesce("ps_end", "_l").alias("ps_end"),
        F.col("ps_start").isNotNull().alias("ps_trimmed"),
    )
    kept = cleaned.join(limits, "video").filter(F.col("frame_idx").between(F.col("ps_start"), F.col("ps_end")))
    kept = durable(kept)

    signal = angle_signal(kept.drop("ps_start", "ps_end", "ps_trimmed"), fps, settings)
    axis = limits.select(
        "video",
        F.lit(0).cast("long").alias("clip"),
        "ps_start",
        F.explode(F.sequence("ps_start", "ps_end")).alias("frame_idx"),
    )
    dense = axis.join(signal, ["video", "clip", "frame_idx"], "left").select(
        "video", "clip", (F.col("frame_idx") - F.col("ps_start")).alias("frame_idx"), "angle_deg", "wrist_z"
    )
    features = K.recording_features(dense, "angle_deg", fps, "wrist_z", settings).drop("clip")
    sizes = videos.select("video", "total_frames")
    seen = tracking.appearance(kept.join(sizes, "video"), F.col("total_frames"))
    gaps = S.occlusion_gaps(kept, F.lit(True), fps, ["video"])
    spans = G.span_and_swing(kept, 1.0, 1.0).drop("span_px")
    confidence = G.confidence_proxy(kept).groupBy("video").agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", "conf_min"))).alias("_c")
    )
    log = videos
    for part in (
        chosen.drop("det_count"),
        limits,
        seen,
        gaps,
        spans,
        confidence.select("video", F.col("_c.conf_min").alias("conf_mcp_min_series")),
        features,
    ):
        log = log.join(part, "video", "left")
    return log.withColumns(
        {"record_type": F.lit("VIDEO"), "main_track_found": F.col("track").isNotNull()}
    )


def merge_cohort(
    logs: DataFrame,
    scores: DataFrame,
    features: Sequence[str],
    thresholds: Mapping[str, float] | None = None,
    id_map: DataFrame | None = None,
    angles: DataFrame | None = None,
    allowed_angles: Sequence[str] | None = None,
    quality_labels: DataFrame | None = None,
    quality_threshold: int = 3,
    demographics: DataFrame | None = None,
    segmented_only: bool = False,
    whole_only: bool = False,
) -> DataFrame:
    """Filtered, keyed and merged recordings, collapsed to one row per condition, with composites.

    The order is fixed: filters, visit, scores, demographics, median collapse, composites.
    """
    df = cohort.threshold_filter(cohort.only_videos(logs), thresholds or {})
    df = df.filter(cohort.segment_mask(F.col("video_path"), segmented_only, whole_only))
    if angles is not None:
        keyed = df.withColumn("angle_key", N.path_match_key(F.col("video_path")))
        df = cohort.attach_labels(keyed, angles, "angle_key", "recording_angle").drop("angle_key")
        if allowed_angles is not None:
            df = df.filter(F.col("recording_angle").isin(cohort.angle_allow_list(allowed_angles)))
    if quality_labels is not None:
        df = cohort.quality_filter(df, quality_labels, "video_path", quality_threshold)
    if id_map is not None:
        df = cohort.map_patients(df, id_map).withColumn("patient", F.col("patient_id")).drop("patient_id", "unmapped")
    keys = ["patient", "visit", "med", "hand"]
    merged = cohort.merge_scores(df, scores.select(*keys, "score"), keys)
    if demographics is not None:
        merged = merged.join(demographics, "patient", "left")
    numeric = cohort.available(merged, [*features, "score", "age", "gender_code"])
    # the earliest recording of a condition stands for it in the paired reports
    other = [*cohort.available(merged, ["video_path", "recording_angle"]), "video"]
    one = cohort.collapse_same_condition(merged, keys, numeric, other, "video")
    one = one.withColumn("score", N.integer_score(F.col("score"))).filter(F.col("score").isNotNull())
    # written once: the composites read it again for the moments of the healthy group
    one = durable(one)
    return cohort.composite_v2(cohort.interaction_features(cohort.composite_score(one)))


class Tables(Mapping[str, DataFrame]):
    """Tables by name, each built when it is first asked for: a report nobody reads costs nothing."""

    def __init__(self, steps: Mapping[str, Callable[[], DataFrame]]):
        self._steps, self._built = dict(steps), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._steps[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._steps

    def __iter__(self) -> Iterator[str]:
        return iter(self._steps)

    def __len__(self) -> int:
        return len(self._steps)


def cohort_report(merged: DataFrame, features: Sequence[str], factors: Sequence[str] = ()) -> Tables:
    """The tables of a cohort analysis, each defined on the merged conditions when it is asked for.

    ``factors`` are video-quality columns.  Tables whose columns are missing are left out: demographics for the
    adjusted features, visits for the longitudinal report, both medication states for the
    paired one, recording angles for theirs.  The tests by score share one profile of the features.
    """
    data = durable(merged)
    present = cohort.available(data, features)
    keys = ["feature"]

    @cache
    def long() -> DataFrame:
        return durable(stats.long_features(data, ["score"], present))

    @cache
    def profiled() -> DataFrame:
        return stats.profile(stats.long_features(data, ["score"], present), keys, "score", "value")

    @cache
    def effects() -> DataFrame:
        return stats.effect_sizes_of(profiled(), keys, "score")

    tables = {
        "correlation": lambda: stats.spearman_of(profiled(), keys),
        "omnibus": lambda: stats.kruskal_of(profiled(), keys),
        "posthoc": lambda: stats.posthoc(long(), keys, "score", "value"),
        "effects": effects,
        "directions": lambda: stats.direction_check(effects()),
        "alignment": lambda: stats.alignment_of(profiled(), "score"),
        "loadings": lambda: pca_varimax(data, present),
        "summary": lambda: steps.summaries(long(), "score"),
        "outliers": lambda: steps.extreme_outliers(long()),
    }
    if {"total_cycles", "amplitude_cv"} <= set(data.columns):
        tables["cycle_counts"] = lambda: steps.cycle_count_check(data, "total_cycles", "amplitude_cv")
    if "age" in data.columns and "gender_code" in data.columns:
        adults = data.withColumn("female", F.when(F.col("gender_code") == 2, 1.0).otherwise(0.0))
        tables["covariates"] = lambda: stats.ancova(
            stats.long_features(adults, ["score", "age", "female"], present), keys, "score", "value", ["age", "female"]
        )
        tables["subgroups"] = lambda: data.groupBy(
            N.age_group(F.col("age")).alias("age_group"), N.gender(F.col("gender_code")).alias("gender"), "score"
        ).agg(F.count(F.lit(1)).alias("n"))
        ids = cohort.available(data, ["patient", "visit", "med", "hand", "score", "age", "gender_code"])
        tables["adjusted"] = lambda: steps.adjusted(stats.long_features(data, ids, present), "value", "age", "gender_code")
    if {"patient", "visit", "med", "hand", "video"} <= set(data.columns):
        tables["longitudinal"] = lambda: progression(data, ["patient", "med", "hand"], present)
        tables["medication"] = lambda: paired.medication_summary(
            paired.medication_pairs(data, ["patient", "visit", "hand"], "med", "video", present)[0], present
        )
    if "recording_angle" in data.columns:
        tables["angles"] = lambda: steps.angle_tests(stats.long_features(data, ["recording_angle"], present), "recording_angle")
        tables["angle_scores"] = lambda: steps.score_shares(data, "recording_angle", "score")
    seen = cohort.available(data, factors)
    if seen:
        tables["factors"] = lambda: steps.summaries(stats.long_features(data, ["score"], seen), "score")
        tables["factor_correlations"] = lambda: steps.factor_correlations(data, seen, present)
        if "signal_quality" in data.columns:
            tables["factor_trends"] = lambda: steps.factor_trends(data, seen, "signal_quality")
    return Tables(tables)


def totals_report(logs: DataFrame, totals: DataFrame, features: Sequence[str]) -> dict[str, DataFrame]:
    """The merge with the total scores of a visit, with the summary and the outliers of each feature."""
    merged = durable(steps.merge_totals(logs, totals, features))
    long = durable(stats.long_features(merged, ["score"], cohort.available(merged, [*features, "composite_score"])))
    return {"merged": merged, "summary": steps.summaries(long, "score"), "outliers": steps.extreme_outliers(long)}


def progression(merged: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Longitudinal summary per feature over the keys with one recording per visit."""
    kept, _ = paired.one_video_per_visit(merged, keys, "visit", "video")
    long = stats.long_features(kept, [*keys, "visit"], features)
    wide = durable(paired.visit_wide(long, keys, "visit", "value", extra=["feature"]))
    return paired.longitudinal_summary(wide, ["feature"])
