"""Normalisation of ids, paths and labels as Column expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens and labels the data sets use.
ON_OFF = r"(?<![A-Za-z])(On|Off)(?![A-Za-z])"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ANGLE_ALIASES = {
    "frontal": "front",
    "front view": "front",
    "angled view": "angled",
    "lateral view": "lateral",
    "side": "lateral",
}
ANGLE_ORDINALS = {"front": 0, "angled": 1, "lateral": 2, "other": 3}
AGE_GROUPS = [(0, 60, "<60"), (60, 70, "60-69"), (70, 200, "70+")]
MALE = ["m", "male", "man", "1"]
FEMALE = ["f", "female", "woman", "2"]
LEFT_WORDS = ["l", "left", "lhs"]
RIGHT_WORDS = ["r", "right", "rhs"]


def _captured(text: Column, pattern: str, group: int) -> Column:
    """Regex group, NULL where the pattern does not match (no group used here can be empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def medication_from_path(path: Column) -> Column:
    return F.initcap(_captured(path, "(?i)" + ON_OFF, 1))


def hand_from_path(path: Column) -> Column:
    flat = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when(path.contains("_4R"), "Right")
        .when(path.contains("_4L"), "Left")
        .when(flat.contains("_right/") | flat.endswith("_right"), "Right")
        .when(flat.contains("_left/") | flat.endswith("_left"), "Left")
    )


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def _folder_visit(path: Column) -> tuple[Column, Column]:
    """(ids, visit) of a ``.../Video/visit N/<ids>`` folder layout."""
    parts = _path_parts(path)
    at = F.array_position(F.transform(parts, F.lower), "video").cast("int")
    # with a leading slash the root counts as one more segment, which does not move the offset
    ids = F.when(at > 0, F.try_element_at(parts, at + 2))
    visit = F.when(at > 0, _captured(F.try_element_at(parts, at + 1), r"(?i)visit\s*(\d+)", 1))
    return F.when(visit.isNotNull(), ids), F.when(ids.isNotNull(), visit)


def ids_and_visit_from_path(path: Column) -> tuple[Column, Column]:
    """Recording id and visit number from the path conventions, first match wins."""
    folder_ids, folder_visit = _folder_visit(path)
    subjects = F.filter(_path_parts(path), lambda s: s.rlike(r"(?i)^Subject_\d+$"))
    subject = F.regexp_extract(F.try_element_at(subjects, F.lit(1)), r"(\d+)", 1)
    number = subject.try_cast("long")
    subject_id = F.concat(
        F.lit("TULIP_"),
        F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")),
    )
    flat = F.replace(path, F.lit("\\\\"), F.lit("/"))
    inline = r"(?i)/Video/visit\s*(\d+)/([^/]+)/"
    token = _captured(flat, r"(?i)(POM\w+)", 1)
    token_visit = _captured(flat, r"(?i)PS_(\d+)", 1)
    ids = F.coalesce(folder_ids, subject_id, _captured(flat, inline, 2), token)
    visit = (
        F.when(folder_ids.isNotNull(), folder_visit.try_cast("int"))
        .when(subject_id.isNotNull(), F.lit(1))
        .when(flat.rlike(inline), F.regexp_extract(flat, inline, 1).try_cast("int"))
        .when(token.isNotNull(), token_visit.try_cast("int"))
    )
    return ids, visit


def canonical_video_id(video_id: Column) -> Column:
    stem = F.substring_index(F.nullif(F.trim(video_id), F.lit("")), ".", 1)
    return F.when(stem.rlike(r"(?i)^TULIP_\d+$"), stem).otherwise(F.substring_index(stem, "_", 1))


def medication_state(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.startswith("on"), "On").when(low.startswith("off"), "Off")


def hand(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return (
        F.when(low.isin(LEFT_WORDS), "Left")
        .when(low.isin(RIGHT_WORDS), "Right")
        .when(low.contains("right") | low.contains("4r"), "Right")
        .when(low.contains("left") | low.contains("4l"), "Left")
    )


def _whole_number(text: Column) -> Column:
    """Integer value of a numeric text within 1e-9 of an integer, else NULL."""
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(number - F.round(number)) < 1e-9, F.round(number).try_cast("int"))


def visit_number(text: Column) -> Column:
    trimmed = F.trim(text.cast("string"))
    return F.coalesce(_whole_number(trimmed), _captured(trimmed, r"(\d+)", 1).try_cast("int"))


def integer_score(text: Column) -> Column:
    return _whole_number(F.trim(text.cast("string")))


def path_match_key(path: Column) -> Column:
    """Canonical file-level key under which tracked outputs and label files meet."""
    flat = F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/")))
    flat = F.regexp_replace(flat, r"_cl_sh_sr4x(?:_gimmvfi)?(?=\.[^./\\]+$|$)", "")
    name = F.element_at(F.split(flat, "/"), -1)

    def uncropped(text: Column) -> Column:
        return F.regexp_replace(text, r"_cropped(?=\.[^./\\]+$|$)", "")

    def squeezed(text: Column) -> Column:
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    marker = "segmented_video_"
    tail = F.substring(name, F.locate(marker, name) + len(marker), F.length(name))
    segmented = F.concat(F.lit("seg::"), uncropped(tail))

    token = _captured(flat, r"(pom\d+vd\d+)", 1)
    hand_tail = _captured(name, r"((?:on|off)_4[lr].*)", 1)
    visit = F.coalesce(_captured(flat, r"visit\s*(\d+)", 1), F.lit("na"))
    clip = F.concat(
        F.lit("clip::v"), visit, F.lit("_"), token, F.lit("_"), uncropped(squeezed(hand_tail))
    )

    # Output folder prefixes that earlier stages put into file names.
    other = name
    for pattern, replacement in (
        (r"^enhanced_videos\d*_", ""),
        (r"enhanced_videos\d*", "cropped_videos_output"),
        (r"^clahe_sharpen_esrgan_videos\d*_", ""),
        (r"clahe_sharpen_esrgan_videos\d*", "cropped_videos_output"),
    ):
        other = F.regexp_replace(other, pattern, replacement)
    other = F.when(
        other.startswith("visit "), F.concat(F.lit("cropped_videos_output_"), other)
    ).otherwise(other)
    return F.coalesce(
        F.when(name.contains(marker), segmented)
        .when(token.isNotNull() & hand_tail.isNotNull(), clip)
        .otherwise(squeezed(other)),
        F.lit(""),
    )


def recording_angle(text: Column) -> Column:
    low = F.nullif(F.lower(F.trim(text)), F.lit(""))
    aliases = F.create_map(*[F.lit(x) for pair in ANGLE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, low), low)


def visit_from_token(text: Column) -> Column:
    return _captured(text, r"(?i)\bPOM([1-3])(?=[A-Za-z0-9])", 1).try_cast("int")


def medication_neutral_key(path: Column) -> Column:
    """File name with its first On/Off token blanked out, NULL when it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    around = r"(?is)^(.*?)" + ON_OFF + r"(.*)$"
    return F.when(
        name.rlike(around),
        F.lower(
            F.concat(
                F.regexp_extract(name, around, 1),
                F.lit("__MED__"),
                F.regexp_extract(name, around, 3),
            )
        ),
    )


def age_group(age: Column) -> Column:
    return reduce(
        lambda acc, band: acc.when((age >= band[0]) & (age < band[1]), band[2]),
        AGE_GROUPS[1:],
        F.when((age >= AGE_GROUPS[0][0]) & (age < AGE_GROUPS[0][1]), AGE_GROUPS[0][2]),
    )


def gender(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(text.cast("string"))), r"\.0$", "")
    return F.when(low.isin(MALE), "Male").when(low.isin(FEMALE), "Female")


def group_label(text: Column) -> Column:
    """Group label as a column-name part."""
    for old, new in ((" ", "_"), ("<", "lt"), ("≥", "ge"), (">=", "ge"), ("+", "plus"), ("-", "_")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def severity(score: Column) -> Column:
    return (
        F.when(score.isin(0, 1), "Mild").when(score == 2, "Moderate").when(score.isin(3, 4), "Severe")
    )


def significance(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p >= 0.05, "ns")
    )


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(size < 0.2, "negligible")
        .when(size < 0.5, "small")
        .when(size < 0.8, "medium")
        .when(size >= 0.8, "LARGE")
    )


def finite(value: Column) -> Column:
    """NaN and infinities become NULL, so SQL aggregates skip them."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
