"""One-off scalar helpers: strides, overlay text, output paths, backend choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_stride(fps: Column, target: float | None) -> Column:
    """Frames to step so that the effective rate stays near the target."""
    if not target or target <= 0:
        return F.lit(1)
    return F.when(fps <= target, 1).otherwise(F.greatest(F.lit(1), F.floor(fps / target).cast("int")))


def score_line(name: str | None, score: Column) -> Column:
    """Overlay text of the clinical score; NULL without a score column."""
    if not name:
        return F.lit(None).cast("string")
    return F.concat(
        F.lit(f"MDS-UPDRS {name}: "), F.coalesce(score.cast("int").cast("string"), F.lit("N/A"))
    )


# Tags of the enhancement stages, in file-name order.
STAGE_TAGS = [
    ("denoise", "dn"),
    ("clahe", "cl"),
    ("sharpen", "sh"),
    ("esrgan", "sr{scale}x"),
    ("rife", "rife"),
    ("hifi", "hifi"),
    ("gimmvfi", "gimmvfi"),
]


def stages_suffix(active: set[str], scale: int = 4) -> str:
    tags = [tag.format(scale=scale) for stage, tag in STAGE_TAGS if stage in active]
    return "_" + "_".join(tags) if tags else ""


def output_path(path: Column, folder: str, suffix: str) -> Column:
    """Output path that keeps the segments below a ``Video`` folder."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.coalesce(F.nullif(F.regexp_extract(name, r".(\.[^.]+)$", 1), F.lit("")), F.lit(""))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    file = F.concat(stem, F.lit(suffix), F.when(ext == "", ".mp4").otherwise(ext))
    at = F.array_position(F.transform(parts, F.lower), "video").cast("int")
    inner = F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    kept = (at > 0) & (at < F.size(parts))
    folders = F.when(kept, F.concat(F.array(F.lit(folder)), F.when(kept, inner))).otherwise(
        F.array(F.lit(folder))
    )
    return F.array_join(F.concat(folders, F.array(file)), "/")


def keypoint_backend(yolo_only: bool, openpose: bool, yolo: bool, rtmpose: bool) -> str:
    """Which refinement a configuration selects."""
    if yolo_only:
        return "yolo_only"
    if rtmpose and openpose:
        return "openpose"
    if yolo:
        return "yolo"
    return "rtmpose" if rtmpose and not openpose else "mediapipe"
