"""Sources and sinks by round trips through files."""

import json
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cantus.functions import models
from cantus.sources import files, midi, paged
from cantus.streaming import tagging


def test_midi_round_trip(spark, tmp_path):
    notes = [("s1", "other", 0, False, 60, 90, 0, 500_000), ("s1", "other", 0, False, 60, 80, 500_000, 750_000), ("s1", "drums", 0, True, 36, 100, 250_000, 300_000), ("s2", " Other", 5, False, 61, 1, 1_000_000, 3_000_000)]
    df = spark.createDataFrame(notes, "song string, track string, program int, is_drum boolean, pitch int, velocity int, start_us long, end_us long")
    for r in midi.midi_files(df).collect():
        (tmp_path / f"{r.song}.mid").write_bytes(r.content)
    (tmp_path / "broken.mid").write_bytes(b"MThd nonsense")
    back = midi.read_midi(spark, str(tmp_path))
    assert back.where("error is not null").count() == 1
    got = {(r.path.rsplit("/", 1)[1][:2], r.track, r.pitch, r.velocity, r.start_us, r.end_us) for r in back.where("error is null").collect()}
    assert got == {(s, t, p, v, a, b) for s, t, _, _, p, v, a, b in notes}
    assert midi.named_tracks(back).where("error is null").count() == 3


def test_ground_truth_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text("onset,offset,pitch,label\n1.5,2.0,60,x\n,,,\n0.5,,36,\nbad,1,2,\n1,0.5,60,\n2,x,60,\n3,4,y,\n")
    valid, errors = files.read_ground_truth(spark, str(tmp_path))
    assert [(r.onset, r.offset, r.pitch) for r in valid.collect()] == [(0.5, None, 36.0), (1.5, 2.0, 60.0)]
    assert sorted(r.error for r in errors.collect()) == ["offset is not a number", "offset is not after onset", "onset is not a number", "pitch is not a number"]


def test_csv_text_json_and_folders(spark, tmp_path):
    for song in ("one", "two"):
        (tmp_path / "tags" / song).mkdir(parents=True)
        (tmp_path / "tags" / song / "note_tags.csv").write_text("onset,offset,pitch,pitch_class,velocity,segment_onset,segment_offset,chord_pitch_classes,tag\n0.5,1,60,0,90,,,,no_chord_data\n")
    df = files.read_csv(spark, str(tmp_path / "tags"), "note_tags")
    assert {(r.song, r.segment_onset, r.tag) for r in df.collect()} == {("one", None, "no_chord_data"), ("two", None, "no_chord_data")}
    assert files.list_folders(spark, str(tmp_path / "tags"), ["note_tags.csv"]).count() == 2
    assert files.list_folders(spark, str(tmp_path / "tags"), ["note_tags.csv", "x"]).count() == 0
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    (tmp_path / "m.txt").write_text("# head\n\n a song \nb\n")
    assert {r.line for r in files.read_manifest(spark, str(tmp_path / "m.txt")).collect()} == {"a song", "b"}
    (tmp_path / "l.txt").write_text("t\ts1\te\nt\ts1\nlonely\n")
    assert [r.song for r in files.read_log(spark, str(tmp_path / "l.txt")).collect()] == ["s1"]
    (tmp_path / "p.json").write_text(json.dumps([{"track_id": "1", "title": "t", "artists_all": ["a", "b"], "duration_ms": 5}]))
    assert files.read_playlist(spark, str(tmp_path / "p.json")).first().artists_all == ["a", "b"]
    paths = spark.createDataFrame([("/x/audio/a.mp3",), ("/x/more/a.wav",), ("/x/more/b.wav",)], "path string")
    assert {r.path for r in files.first_folder_wins(paths, ["audio", "more"]).collect()} == {"/x/audio/a.mp3", "/x/more/b.wav"}
    at = spark.createDataFrame([("a", 1), ("b", 5)], "song string, at int")
    assert [r.song for r in files.stale(at, at.withColumn("at", F.lit(3))).collect()] == ["a"]


def test_grids_and_audio(spark, tmp_path):
    np.savez(tmp_path / "g.npz", note=np.array([[0.1, 0.9], [0.4, 0.0]]))
    got = {(r.frame, r.bin): r.level for r in files.read_grids(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 0.1, (0, 1): 0.9, (1, 0): 0.4, (1, 1): 0.0}
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, 2, 10, 0, "NONE", ""))
        w.writeframes(np.arange(40, dtype=np.int16).tobytes())
    df = files.read_audio(spark, str(tmp_path))
    assert df.first().samples[:2] == [0.5, 2.5]
    assert files.slice_audio(df, 0.5, 1.0).first().samples == [10.5, 12.5, 14.5, 16.5, 18.5]


def test_paged_source(spark, tmp_path):
    track = lambda i, local=False: {"track": {"id": i, "name": "n", "is_local": local, "artists": [{"name": "x"}]}}
    (tmp_path / "page1.json").write_text(json.dumps([track("a"), True, None, {"track": None}, track("b", True)]))
    (tmp_path / "page2.json").write_text(json.dumps([track("c")]))
    paged.register(spark)
    df = spark.read.format("paged_playlist").option("path", str(tmp_path)).load()
    assert {(r.page, r.track_id) for r in df.collect()} == {(1, "a"), (2, "c")}


def test_model_hooks(spark):
    df = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    assert "no model" in models.apply_model(df, "transcribe_drums").first().error
    models.HOOKS["transcribe_drums"] = lambda content: [(1000, 36), (2000, 38)]
    try:
        assert models.apply_model(df, "transcribe_drums").count() == 2
    finally:
        models.HOOKS.clear()


def test_streamed_notes(spark, tmp_path):
    segs = spark.createDataFrame([("a", 0, 15_000_000, 145)], "song string, start_us long, end_us long, mask int")
    pd.DataFrame({"song": ["a"] * 4, "onset_us": [1, 14_999_999, 15_000_000, 5], "pitch": [60, 61, 60, 64], "at": pd.to_datetime(["2025-01-01"] * 4)}).to_parquet(tmp_path / "n.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("song string, onset_us long, pitch long, at timestamp").parquet(str(tmp_path))
    q = tagging.density_stream(tagging.tag_stream(stream, segs), "at").writeStream.format("memory").queryName("tagged").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n_notes, r.n_outside) for r in spark.table("tagged").collect()] == [(3, 1)]


def test_analyses_as_rows(spark, tmp_path):
    import json

    from cantus.sources import analysis as A

    section = dict(start=0.0, duration=2.5, tempo=120.0, key=4, mode=1, loudness=-5.0, time_signature=4, key_confidence=0.5)
    segment = dict(start=0.0, duration=0.2, pitches=[0.1] * 12, timbre=[1.0] * 12, loudness_start=-20.0, loudness_max=-3.0)
    df = spark.createDataFrame([("t1", json.dumps({"sections": [section, section], "segments": [segment]})), ("t2", "{}"), ("t3", "no json"), ("t4", None)], "track_id string, analysis string")
    got = A.sections(df).collect()
    assert [(r.track_id, r.place, r.key, r.tempo_confidence, r.key_confidence) for r in got] == [("t1", 0, 4, None, 0.5), ("t1", 1, 4, None, 0.5)]
    assert [(r.track_id, len(r.pitches), len(r.timbre)) for r in A.segment_pitches(df).collect()] == [("t1", 12, 12)]
    songs = spark.createDataFrame([("t1", "x", "y", 5), ("t9", "z", None, None)], "track_id string, title string, artist string, duration_ms bigint")
    asked = []

    def fetch(ids):
        if "t9" in ids:
            raise OSError("no service")
        return [json.dumps({"tempo": 99.5, "key": 3}) for _ in ids]

    found = A.feature_batches(songs.where("track_id = 't1'"), fetch).unionByName(A.feature_batches(songs.where("track_id = 't9'"), fetch))
    assert {(r.track_id, r.error) for r in found.collect()} == {("t1", None), ("t9", "OSError: no service")}
    summary = A.track_summary(songs, found)
    assert len(summary.columns) == 14 and {(r.track_id, r.tempo, r.key, r.energy) for r in summary.collect()} == {("t1", 99.5, 3, None), ("t9", None, None, None)}
    A.write_json(summary, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and not asked
    files = spark.createDataFrame([("/a/x.MP3",), ("/a/y.txt",), ("/a/z.flac",), ("/a/wav",)], "path string")
    assert sorted(r.path for r in A.audio_files(files).collect()) == ["/a/x.MP3", "/a/z.flac"]


def test_jobs_resume_retry_and_append(spark, tmp_path):
    from cantus.sources import jobs as J

    names = lambda *x: spark.createDataFrame([(i,) for i in x], "song string")
    log = str(tmp_path / "failures")
    assert J.read_failures(spark, log).count() == 0
    results = spark.createDataFrame([("a", 1, None), ("b", None, "broken")], "song string, n int, error string")
    assert [tuple(r) for r in J.log_failures(results, "tag", log).collect()] == [("a", 1)]
    assert [r.song for r in J.read_failures(spark, log).collect()] == ["b"]
    left = lambda **kw: [r.song for r in J.pending(names("d", "c", "b", "a"), names("a"), failed=J.read_failures(spark, log), **kw).collect()]
    assert left() == ["c", "d"] and left(retry_failed=True) == ["b", "c", "d"] and left(limit=1) == ["c"]
    J.clear_failures(spark, log, "tag")
    assert left() == ["b", "c", "d"]
    J.scaffold(spark, str(tmp_path / "gt"), "onset double, label string")
    J.scaffold(spark, str(tmp_path / "gt"), "other int")
    df = spark.createDataFrame([("a", 0.123456, 2.0)], "song string, rate double, mean double")
    assert [tuple(r) for r in J.formatted(df, ["rate"], ["mean"]).collect()] == [("a", "0.1235", "2.00")]
    out = str(tmp_path / "parts")
    J.write_in_parts(df, out, "song")
    J.write_in_parts(df.unionByName(df.withColumn("song", J.F.lit("b"))), out, "song", spark.read.parquet(out))
    assert sorted(r.song for r in spark.read.parquet(out).collect()) == ["a", "b"]
