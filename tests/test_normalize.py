"""Normalisation rules on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from oscilla.functions import naming, normalize as N


def evaluate(spark, values, *columns, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (N.medication_from_path, {"a/POM_On_4R": "On", "x/off.mp4": "Off", "Monday": None, "ON-1": "On"}),
        (N.hand_from_path, {"a_4R": "Right", "a_4L.mp4": "Left", "13. x_left/c.mp4": "Left", "b\\x_RIGHT": "Right", "q": None}),
        (N.canonical_video_id, {" SUBJ1_PS_002 ": "SUBJ1", "TULIP_001.mp4": "TULIP_001", "": None, "A.b_c": "A"}),
        (N.medication_state, {" ON state": "On", "offline": "Off", "x": None, None: None}),
        (N.hand, {"LHS": "Left", "r": "Right", "x 4l": "Left", "both": None}),
        (N.visit_number, {"2": 2, " 3.0 ": 3, "visit 12b": 12, "": None, "7.5": 7, "x": None, None: None}),
        (N.integer_score, {"2": 2, "2.0": 2, "2.5": None, "v2": None, "1e1": 10}),
        (N.recording_angle, {" Frontal": "front", "SIDE": "lateral", "odd": "odd", "  ": None}),
        (N.visit_from_token, {"POM2VD1": 2, "a POM4x": None, "xPOM1a": None, "POM3": None}),
        (N.medication_neutral_key, {"d/A_On_Off.mp4": "a___med___off.mp4", "d/none.mp4": None}),
        (
            N.path_match_key,
            {
                "C:\\a\\Window_segmented_video_X_cropped.mp4": "seg::x.mp4",
                "/v/Visit 2/POM1VD22/Off_4R  a_cl_sh_sr4x_gimmvfi.mp4": "clip::v2_pom1vd22_off_4r a.mp4",
                "POM1VD22_on_4l.mp4": "clip::vna_pom1vd22_on_4l.mp4",
                "enhanced_videos3_a b.mp4": "a b.mp4",
                "x_clahe_sharpen_esrgan_videos1_y": "x_cropped_videos_output_y",
                "visit 1.mp4": "cropped_videos_output_visit 1.mp4",
                None: "",
            },
        ),
    ],
)
def test_text_rules(spark, rule, cases):
    assert evaluate(spark, list(cases), rule(F.col("x"))) == list(cases.values())


def test_ids_and_visit(spark):
    cases = {
        "/d/Video/visit 3/POM9/Off_4R.mp4": ("POM9", 3),
        "/d/VIDEO/Visit3/ab/c.mp4": ("ab", 3),
        "/d/Subject_7/13. x_left/c.mp4": ("TULIP_007", 1),
        "/d/Subject_1234/c.mp4": ("TULIP_1234", 1),
        "seg_POM2VD8_PS_2_4.mp4": ("POM2VD8_PS_2_4", 2),
        "/d/plain.mp4": (None, None),
    }
    assert evaluate(spark, list(cases), *N.ids_and_visit_from_path(F.col("x"))) == list(cases.values())


def test_numeric_labels(spark):
    ages = [-1.0, 0.0, 59.9, 60.0, 70.0, 200.0, None]
    got = evaluate(spark, ages, N.age_group(F.col("x")), schema="x double")
    assert got == [None, "<60", "<60", "60-69", "70+", None, None]
    assert evaluate(spark, [1.0, 2.0, 3.0], N.gender(F.col("x")), schema="x double") == ["Male", "Female", None]
    assert evaluate(spark, [0.0009, 0.009, 0.04, 0.05], N.significance(F.col("x")), schema="x double") == ["***", "**", "*", "ns"]
    assert evaluate(spark, [-0.1, 0.3, -0.6, 2.0], N.effect_label(F.col("x")), schema="x double") == ["negligible", "small", "medium", "LARGE"]
    assert evaluate(spark, ["<60", "70+", "60-69"], N.group_label(F.col("x"))) == ["lt60", "70plus", "60_69"]


def test_naming(spark):
    assert evaluate(spark, [100.0, 24.0], naming.frame_stride(F.col("x"), 25.0), schema="x double") == [4, 1]
    assert evaluate(spark, ["/a/Video/visit 1/P/Off.mp4", "b.mp4"], naming.output_path(F.col("x"), "/o", "_cl")) == [
        "/o/visit 1/P/Off_cl.mp4",
        "/o/b_cl.mp4",
    ]
    assert naming.stages_suffix({"clahe", "esrgan"}, 2) == "_cl_sr2x"
    assert naming.keypoint_backend(False, True, False, True) == "openpose"
