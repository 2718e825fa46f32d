"""Small operators: encoders, scans of lines and JSON, grids, deduplication of sources."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.operators.ordered import with_context
from cantus.plans.registry import query
from cantus.plans.storage import table
from cantus.sources import music

# Drum note length and velocity, ticks a second, programs of the merged tracks, level marks.
DRUM_NOTE_US, DRUM_VELOCITY, TICKS_A_SECOND, BASS_PROGRAM, OTHER_PROGRAM = 50_000, 100, 960, 33, 0


@query("""SELECT song, annotation_id, is_on, pitch, CASE WHEN is_on THEN 100 ELSE 0 END AS velocity, tick, greatest(0, tick - coalesce(max(tick) OVER (PARTITION BY song ORDER BY t, is_on, annotation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS delta FROM
(SELECT song, annotation_id, pitch, onset_us + e.o * 50000 AS t, e.o = 0 AS is_on, CAST(round_even((onset_us + e.o * 50000) / 1000000.0 * 960, 0) AS BIGINT) AS tick FROM gt, (SELECT unnest([0, 1]) AS o) e WHERE stem = 'drums' AND onset_us IS NOT NULL)""", ("gt",))
def drum_events(spark: SparkSession, d: str) -> DataFrame:
    """Drum onsets as on and off events in ticks, rounded to the nearest, offs first at equal times, each with its ticks since the latest event before.

    Events are in the order of their times and rounding keeps that order, so the tick of
    the event before is the running maximum. No time lies halfway between two ticks:
    960 ticks a second are 3 a 3,125 microseconds.
    """
    df = music.annotations(spark, d).where("stem = 'drums' and onset_us is not null").select("song", "annotation_id", "pitch", F.explode(F.array(F.struct(F.col("onset_us").alias("t"), F.lit(True).alias("is_on")), F.struct((F.col("onset_us") + DRUM_NOTE_US).alias("t"), F.lit(False).alias("is_on")))).alias("e")).select("song", "annotation_id", "pitch", "e.*")
    df = df.withColumn("tick", F.expr(f"(2 * t * {TICKS_A_SECOND} + 1000000) div 2000000")).withColumn("tie", F.struct("is_on", "annotation_id"))
    df = with_context(df, "song", "t", "tie", F.col("tick"), before=1)
    return df.select("song", "annotation_id", "is_on", "pitch", F.when(F.col("is_on"), DRUM_VELOCITY).otherwise(0).alias("velocity"), "tick", F.greatest(F.lit(0), F.col("tick") - F.coalesce(F.get("prev", F.lit(0)), F.lit(0))).alias("delta"))


@query("""SELECT s.song, s.track, CASE s.track WHEN 'bass' THEN 33 WHEN 'drums' THEN NULL ELSE 0 END AS program, s.track = 'drums' AS is_drum, count(t.song) AS n_notes, count(t.song) = 0 AS empty, max(coalesce(t.offset_us, t.onset_us)) AS end_us
FROM (SELECT song, unnest(['bass', 'drums', 'other']) AS track FROM (SELECT song FROM note UNION SELECT song FROM gt)) s
LEFT JOIN (SELECT song, 'other' AS track, onset_us, offset_us FROM note UNION ALL SELECT song, stem, onset_us, offset_us FROM gt WHERE stem IN ('bass', 'drums') AND onset_us IS NOT NULL) t ON t.song = s.song AND t.track = s.track GROUP BY s.song, s.track""", ("note", "gt"))
def merge_stems(spark: SparkSession, d: str) -> DataFrame:
    """Three stems merged into one table of tracks, with each track's size and end; missing tracks are empty."""
    notes, gt = music.notes(spark, d), music.annotations(spark, d)
    tracks = notes.select("song", F.lit("other").alias("track"), "onset_us", "offset_us").unionByName(gt.where("stem in ('bass', 'drums') and onset_us is not null").select("song", F.col("stem").alias("track"), "onset_us", "offset_us"))
    stems = F.array(*(F.lit(s) for s in ("bass", "drums", "other")))
    every = notes.select("song").union(gt.select("song")).distinct().select("song", F.explode(stems).alias("track"))
    have = tracks.groupBy("song", "track").agg(F.count("*").alias("n"), F.max(F.coalesce("offset_us", "onset_us")).alias("end_us"))
    df = every.join(have, ["song", "track"], "left")
    program = F.when(F.col("track") == "bass", BASS_PROGRAM).when(F.col("track") == "other", OTHER_PROGRAM)
    return df.select("song", "track", program.alias("program"), (F.col("track") == "drums").alias("is_drum"), F.coalesce("n", F.lit(0)).alias("n_notes"), F.col("n").isNull().alias("empty"), "end_us")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS key_class FROM events")
def json_projection(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON column as typed columns."""
    df = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return df.select("event_id", "p.k", (F.col("p.k") % 12).alias("key_class"))


GRID_SQL = "grid AS (SELECT event_type AS bin, epoch_us(date_trunc('day', ts)) AS frame, max(value) AS v FROM events GROUP BY ALL), peak AS (SELECT max(v) AS top FROM grid)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """(bin, frame, level): an activation grid of event types by days, levels from 0 to 1."""
    ts = F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))
    grid = table(spark, d, "events").groupBy(F.col("event_type").alias("bin"), ts.alias("frame")).agg(F.max("value").alias("v"))
    return grid.crossJoin(F.broadcast(grid.agg(F.max("v").alias("top")))).select("bin", "frame", (F.col("v") / F.col("top")).alias("level"))


@query("SELECT bin, round(max(v / top), 6) AS peak, arg_min(frame, struct_pack(a := -v, b := frame)) AS peak_at, min(frame) FILTER (v / top >= 0.5) AS first_active, max(frame) FILTER (v / top >= 0.5) AS last_active FROM grid, peak GROUP BY bin HAVING max(v / top) >= 0.05", (), (GRID_SQL,))
def activation_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins whose peak reaches the floor: peak, its first time, first and last active time."""
    active = F.when(F.col("level") >= 0.5, F.col("frame"))
    df = _grid(spark, d).groupBy("bin").agg(F.max("level").alias("p"), F.min_by("frame", F.struct((-F.col("level")).alias("a"), "frame")).alias("peak_at"), F.min(active).alias("first_active"), F.max(active).alias("last_active")).where("p >= 0.05")
    return df.select("bin", F.round("p", 6).alias("peak"), "peak_at", "first_active", "last_active").orderBy(F.desc("peak"))


@query("SELECT bin, string_agg(CASE WHEN v / top >= 0.5 THEN '#' WHEN v / top >= 0.3 THEN '=' WHEN v / top >= 0.15 THEN '-' ELSE '.' END, '' ORDER BY frame) AS strip FROM grid, peak GROUP BY bin", (), (GRID_SQL,))
def activation_strip(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("level") >= 0.5, "#").when(F.col("level") >= 0.3, "=").when(F.col("level") >= 0.15, "-").otherwise(".")
    df = _grid(spark, d).groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("frame", mark.alias("m")))).alias("x"))
    return df.select("bin", F.array_join(F.transform("x", lambda x: x.m), "").alias("strip"))


@query("SELECT track_id, coalesce(nullif(regexp_extract(link, 'playlist/([a-zA-Z0-9]+)', 1), ''), trim(link)) AS playlist FROM (SELECT DISTINCT track_id, CASE WHEN length(title) % 2 = 0 THEN 'https://example.org/playlist/' || track_id || '?si=1' ELSE ' ' || track_id || ' ' END AS link FROM k_indie_songs)")
def playlist_ids(spark: SparkSession, d: str) -> DataFrame:
    """Playlist ids from links, or the trimmed input."""
    link = F.when(F.length("title") % 2 == 0, F.concat(F.lit("https://example.org/playlist/"), "track_id", F.lit("?si=1"))).otherwise(F.concat(F.lit(" "), "track_id", F.lit(" ")))
    df = table(spark, d, "k_indie_songs").select("track_id", link.alias("link")).distinct()
    return df.select("track_id", F.coalesce(F.nullif(F.regexp_extract("link", r"playlist/([a-zA-Z0-9]+)", 1), F.lit("")), F.trim("link")).alias("playlist"))


@query("SELECT source, line, count(*) AS n FROM (SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(13) || chr(9)) AS line FROM documents) WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY ALL")
def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text manifests by source, without blanks and comments."""
    df = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("l")).select("source", F.trim(F.col("l"), F.lit(" \r\t")).alias("line"))
    return df.where("line <> '' and not startswith(line, '#')").groupBy("source", "line").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source, split_part(line, ' ', 2) AS field FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(string_split(line, ' ')) >= 2")
def log_fields(spark: SparkSession, d: str) -> DataFrame:
    """The distinct second fields, by source, of lines that have at least two; the fields of the test logs are parted by spaces."""
    df = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).select("source", F.split("line", " ").alias("f"))
    return df.where(F.size("f") >= 2).select("source", F.get("f", F.lit(1)).alias("field")).distinct()


@query("SELECT stem, id, folder FROM (SELECT lower(title) AS stem, track_id AS id, 0 AS folder FROM k_indie_songs UNION SELECT lower(title), liked_id, 1 FROM liked_songs) QUALIFY row_number() OVER (PARTITION BY stem ORDER BY folder, id) = 1")
def first_source_wins(spark: SparkSession, d: str) -> DataFrame:
    """Songs of two folders by lower-case title, the first folder's first file kept."""
    a = table(spark, d, "k_indie_songs").select(F.lower("title").alias("stem"), F.col("track_id").alias("id"), F.lit(0).alias("folder"))
    b = table(spark, d, "liked_songs").select(F.lower("title").alias("stem"), F.col("liked_id").alias("id"), F.lit(1).alias("folder"))
    return a.unionByName(b).groupBy("stem").agg(F.min(F.struct("folder", "id")).alias("x")).select("stem", "x.id", "x.folder")


def resolve(songs: DataFrame, wanted: str, cutoff: float = 0.6) -> DataFrame:
    """(wanted, song, how) for a name typed by hand: exact, else the only name that contains it, else the only close match.

    More than one containing name resolves to none (song NULL). The ratio of the last
    step is Ratcliff-Obershelp's, which no built-in function has.
    """
    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        return s.map(lambda x: difflib.SequenceMatcher(None, x, wanted).ratio())

    names = songs.select("song").distinct()
    how = F.when(F.col("song") == wanted, 3).when(F.contains(F.lower("song"), F.lit(wanted.lower())), 2).when(ratio("song") >= cutoff, 1).otherwise(0)
    best = names.withColumn("rank", how).where("rank > 0").groupBy("rank").agg(F.count("*").alias("n"), F.min("song").alias("song"))
    top = best.agg(F.max_by(F.struct("n", "song", "rank"), "rank").alias("x"))
    kind = F.element_at(F.create_map(F.lit(3), F.lit("exact"), F.lit(2), F.lit("contains"), F.lit(1), F.lit("close")), F.col("x.rank"))
    return top.select(F.lit(wanted).alias("wanted"), F.when(F.col("x.n") == 1, F.col("x.song")).alias("song"), F.when(F.col("x.n") == 1, kind).otherwise("none").alias("how"))


@query()
def resolve_songs(spark: SparkSession, d: str) -> DataFrame:
    songs = table(spark, d, "chord_sequences").select("song")
    out = None
    for name in ("Ranchan Ramcheom - Rusty Planet (Demo) (Official Music Video)", "silver, electric, cinema", "Ranchan", "no such song at all"):
        one = resolve(songs, name)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) FILTER (lower(trim(stem)) = 'other') AS other_tracks, song, CASE WHEN count(*) FILTER (lower(trim(stem)) = 'other') = 1 THEN 'ok' WHEN count(*) FILTER (lower(trim(stem)) = 'other') = 0 THEN 'none' ELSE 'several' END AS status FROM (SELECT DISTINCT song, stem FROM gt_annotations WHERE song IS NOT NULL) GROUP BY song")
def single_track_status(spark: SparkSession, d: str) -> DataFrame:
    """Songs whose spelled stems name the track 'other' exactly once."""
    df = table(spark, d, "gt_annotations").where("song is not null").select("song", "stem").distinct().groupBy("song").agg(F.count_if(F.lower(F.trim("stem")) == "other").alias("other_tracks"))
    return df.select("other_tracks", "song", F.when(F.col("other_tracks") == 1, "ok").when(F.col("other_tracks") == 0, "none").otherwise("several").alias("status"))
