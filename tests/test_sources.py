"""Readers and sinks on files written by the tests, and the streaming twins."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from oscilla import config
from oscilla.operators import jobs, tracking
from oscilla.sources import readers as R
from oscilla.sources import sinks
from oscilla.streaming import twins


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scores_with_sniffed_separator(spark, tmp_path):
    path = write(tmp_path / "s.csv", "ids;visit;medication_state;hand;ProS\n A1 ;visit 2;ON;r;3.0\nB2;;off;left;2.5\n")
    got = R.read_clinical_scores(spark, path, "ProS")
    assert rows(got, "ids", "hand", "score_clean") == [("A1", "Right", 3), ("B2", "Left", None)]
    assert [r[0] for r in got.orderBy("ids").select("visit").collect()] == [2, None]
    assert R.read_clinical_scores(spark, path, "absent").filter("score_clean is not null").count() == 0


def test_id_map_last_line_wins(spark, tmp_path):
    text = "P1,\"('POM1VD1', 'POM1VD2')\"\nP2,\"['POM1VD2']\"\nP3,POM3VD7\nP4,12\n"
    got = R.read_id_map(spark, write(tmp_path / "m.csv", text))
    assert rows(got, "video_id", "patient_id") == [("12", "P4"), ("POM1VD1", "P1"), ("POM1VD2", "P2"), ("POM3VD7", "P3")]
    with pytest.raises(ValueError):
        R.read_id_map(spark, write(tmp_path / "one.csv", "P1\n"))


def test_age_gender_first_row_per_id(spark, tmp_path):
    got = R.read_age_gender(spark, write(tmp_path / "a.csv", "who,age,Gender\nx,60,1\nx,70,2\ny,old,2\n"))
    assert [tuple(r) for r in got.orderBy("ids").collect()] == [("x", 60.0, 1.0), ("y", None, 2.0)]


def test_xlsx_cells_are_positional(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = (
        f"<worksheet {ns}><sheetData>"
        '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row>'
        '<row><c t="s"><v>2</v></c><c t="s"><v>3</v></c></row>'
        '<row><c t="str"><v>b.mp4</v></c></row>'
        "</sheetData></worksheet>"
    )
    shared = f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in ("video_path", "recording_angle", "a.mp4", "Side")) + "</sst>"
    path = tmp_path / "l.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    assert rows(R.read_recording_angles(spark, str(path)), "angle_key", "recording_angle") == [("a.mp4", "lateral")]


def test_xlsx_references(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def book(name, last):
        sheet = (
            f"<worksheet {ns}><sheetData>"
            '<row><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="C1" t="str"><v>c</v></c></row>'
            f'<row><c r="C2" t="b"><v>1</v></c>{last}</row>'
            "</sheetData></worksheet>"
        )
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", sheet)
        return R.read_xlsx(spark, str(tmp_path / name))

    df = book("a.xlsx", "")
    assert df.columns == ["a", "col_1", "c"] and [tuple(r) for r in df.collect()] == [(None, None, "true")]
    with pytest.raises(Exception, match="more cells than column names in row 2"):
        book("b.xlsx", '<c r="D2"><v>4</v></c>').collect()


def test_label_files(spark, tmp_path):
    q = write(tmp_path / "q.csv", "video_path,quality_label\n/x/A.mp4,3\n/y/a.mp4,1\nb.mp4,7\nc.mp4,bad\n")
    assert rows(R.read_quality_labels(spark, q), "quality_key", "quality_label") == [("a.mp4", 1)]
    with pytest.raises(ValueError):
        R.read_recording_angles(spark, q)
    u = write(tmp_path / "u.csv", "IDs\tUPDRS_v1_off\tupdrs_v2_on\nP1\t20\t\nP2\tx\t31\n")
    assert rows(R.read_updrs_total(spark, u), "ids", "visit", "med", "updrs_total") == [("P1", 1, "Off", 20.0), ("P2", 2, "On", 31.0)]


def test_series_round_trip(spark):
    df = spark.createDataFrame([([1.0, float("nan"), None, float("inf"), 2.00005, 0.1],)], "x array<double>")
    text = df.select(sinks.encode_series(F.col("x")).alias("t"))
    assert json.loads(text.first()["t"]) == [1.0, None, None, None, pytest.approx(2.0, abs=1e-3), 0.1]
    back = text.select(R.series(F.col("t")).alias("x")).first()["x"]
    assert back[0] == 1.0 and back[1] is None and len(back) == 6
    assert spark.range(1).select(R.series(F.lit("[1, x")).alias("x")).first()["x"] is None


def test_fixed_length_export(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0] * 10,)], "x array<double>")
    a, b = [r[0] for r in df.select(sinks.fixed_length(F.col("x"), 5)).collect()]
    assert len(a) == len(b) == 5 and a[3:] == [0.0, 0.0] and sum(a) == pytest.approx(0) and b == [5.0] * 5


def test_logs_append_compact_and_reports(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.write_log(spark.createDataFrame([("v", 1, "ERROR")], "task string, seq int, record_type string"), log)
    sinks.write_log(spark.createDataFrame([("v", 2, "VIDEO")], "task string, seq int, record_type string"), log)
    sinks.compact_log(R.read_tracking_log(spark, log), str(tmp_path / "c"), ["task"], "seq")
    assert rows(spark.read.parquet(str(tmp_path / "c")), "seq", "record_type") == [(2, "VIDEO")]
    assert jobs.to_retry(spark.read.parquet(log), ["task"]).count() == 0
    df = spark.createDataFrame([("train", "0 0.5"), ("val", "0 0.1")], "split string, line string")
    sinks.write_label_lines(df, str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).count() == 2
    for fmt in ("csv", "json", "parquet"):
        sinks.write_report(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_discover_videos_and_ratings(spark, tmp_path):
    for n, folder, name in ((2, "13. Pronation_and_supination_left", "cam Camera 3.mp4"), (11, "14. Pronation_and_supination_right", "x.mp4"), (3, "12. other", "y.mp4")):
        d = tmp_path / f"Subject_{n}" / folder
        d.mkdir(parents=True)
        (d / name).write_bytes(b"x")
    got = R.discover_videos(spark, str(tmp_path))
    assert rows(got, "subject_id", "hand", "camera") == [("TULIP_002", "Left", 3), ("TULIP_011", "Right", 0)]
    ratings = spark.createDataFrame([(2, "Left", "1", "2", None), (3, "Left", "2", "3", None), (4, "Left", "1", "3", "4")], "subject_num int, hand string, a string, b string, c string")
    tables = R.dataset_tables(got, ratings, ["a", "b", "c"], cameras=[3])
    assert rows(tables["scores"], "ids", "score") == [("TULIP_002", 2), ("TULIP_003", 2), ("TULIP_004", 3)]
    assert tables["videos"].count() == 1
    votes = spark.createDataFrame([("PD", "pd", "HT"), ("PD", "HT", None), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in votes.select(R.rater_diagnosis(["a", "b", "c"])).collect()] == ["PD", "HT", None]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "tune.yaml").write_text("MAX_GAP: 5\ndetrend_order: 2\n")
    (tmp_path / "c.yaml").write_text("paths: {log: $HOME/x}\nprocessing: {n_videos: 3}\ntuning_profile: tune.yaml\n")
    options, settings = config.load_settings(str(tmp_path / "c.yaml"))
    assert settings.max_gap == 5 and settings.detrend_order == 2 and options["n_videos"] == 3
    assert "$" not in options["log"]
    with pytest.raises(KeyError):
        config.DEFAULTS.with_overrides({"nope": 1})
    with pytest.raises(ValueError):
        config.Settings(freq_low_hz=5.0)


def test_tracker_stream_equals_batch(spark, tmp_path, sf_dir):
    from oscilla.sources.fixtures import detections

    dets = detections(spark, sf_dir)
    wrist = F.get("lm", F.lit(0))
    flat = dets.select("video", "frame_idx", "det_idx", "label", wrist["x"].alias("x"), wrist["y"].alias("y"))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "video long, frame_idx long, det_idx long, label string, x double, y double"
    batch = {tuple(r) for r in tracking.associate(dets, 25.0, "Left").select("video", "frame_idx", "det_idx", "track").collect()}
    for low, high in ((0, 50), (50, 90), (90, 200)):
        flat.filter(F.col("frame_idx").between(low, high - 1)).coalesce(1).write.mode("append").parquet(src)
        stream = twins.stream_table(spark, src, schema)
        q = twins.append_log(twins.track_stream(stream, 25.0, "Left"), out, str(tmp_path / "cp"))
        q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(out).select("video", "frame_idx", "det_idx", "track").collect()}
    assert got == batch


def test_activity_session_stream(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.sql("SELECT 1L AS video, timestamp_seconds(id) AS ts FROM range(10) UNION ALL SELECT 1L, timestamp_seconds(100 + id) FROM range(5) UNION ALL SELECT 1L, timestamp_seconds(900)").coalesce(1).write.parquet(src)
    stream = twins.stream_table(spark, src, "video long, ts timestamp")
    sessions = twins.activity_sessions(stream, ["video"], "ts", "3 seconds", "10 seconds")
    twins.append_log(sessions, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "o")), "n") == [(5,), (10,)]


def test_tracks_of_a_stream_with_times(spark, tmp_path):
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    frames = "SELECT v AS video, i AS frame_idx, 0L AS det_idx, 'Left' AS label, 0.5D AS x, 0.5D AS y, timestamp_seconds({start} + i) AS ts FROM range({n}) AS t(i), (SELECT {v} AS v)"
    # the first watermark is the epoch: rows at that very time would count as late
    for v, start, n in ((1, 1_000, 5), (2, 10_000, 4), (3, 20_000, 3)):
        spark.sql(frames.format(v=f"'r{v}'", start=start, n=n)).coalesce(1).write.mode("append").parquet(src)
        stream = twins.stream_table(spark, src, "video string, frame_idx long, det_idx long, label string, x double, y double, ts timestamp")
        twins.append_log(twins.track_stream(stream, 25.0, "Left", ts="ts", lateness="1 minute"), out, str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(out).groupBy("video").agg(F.count("*").alias("n"), F.max("track").alias("t"))
    assert rows(got, "video", "n", "t") == [("r1", 5, 0), ("r2", 4, 0), ("r3", 3, 0)]


def test_subject_numbers_beyond_three_digits(spark):
    videos = spark.createDataFrame([("TULIP_1234", 0, "/v/1234.mp4")], "subject_id string, camera int, video_path string")
    ratings = spark.createDataFrame([(1234, "Left", "1"), (123, "Left", "2"), (7, "Left", None)], "subject_num long, hand string, a string")
    tables = R.dataset_tables(videos, ratings, ["a"])
    assert rows(tables["scores"], "ids", "score") == [("TULIP_123", 2), ("TULIP_1234", 1)]


def test_dataset_files_round_trip(spark, tmp_path):
    videos = spark.createDataFrame([("TULIP_001", 0, "/v/a, b.mp4"), ("TULIP_002", 1, "/v/c.mp4")], "subject_id string, camera int, video_path string")
    ratings = spark.createDataFrame([(1, "Left", "1", "2")], "subject_num long, hand string, a string, b string")
    paths = sinks.write_dataset(R.dataset_tables(videos, ratings, ["a", "b"], cameras=[0]), str(tmp_path))
    assert rows(R.read_video_list(spark, paths["videos"]), "video_path", "visit") == [("/v/a, b.mp4", None)]
    assert rows(R.read_id_map(spark, paths["id_map"]), "patient_id", "video_id") == [("TULIP_001", "TULIP_001")]
    got = R.read_clinical_scores(spark, paths["scores"], "score")
    assert rows(got, "ids", "visit", "medication_state", "hand", "score_clean") == [("TULIP_001", 1, "Off", "Left", 2)]
