"""Segments, tagging and review ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.functions.chords import set_text
from cantus.operators.ordered import interval_as_of, with_context
from cantus.plans.registry import query
from cantus.sources import music
from cantus.sources.music import micros  # noqa: F401

TAGGED_SQL = """
ends AS (SELECT song, start_us, end_us, mask, cls FROM seg WHERE mask IS NOT NULL AND end_us IS NOT NULL),
held AS (SELECT n.*, e.start_us AS seg_start, e.end_us AS seg_end, e.mask AS seg_mask FROM note n ASOF LEFT JOIN ends e ON n.song = e.song AND n.onset_us >= e.start_us),
tagged AS (SELECT note_id, song, onset_us, offset_us, pitch, velocity, CASE WHEN onset_us < seg_end THEN seg_start END AS seg_start_us, CASE WHEN onset_us < seg_end THEN seg_end END AS seg_end_us,
  CASE WHEN onset_us < seg_end THEN seg_mask END AS mask,
  CASE WHEN seg_end IS NULL OR onset_us >= seg_end THEN 'no_chord_data' WHEN (seg_mask >> (pitch % 12)) & 1 = 1 THEN 'chord_tone' ELSE 'non_chord_tone' END AS tag FROM held)"""
DENSITY_SQL = """
density AS (SELECT song, seg_start_us, seg_end_us, mask, count(*) AS n_notes, count(*) FILTER (tag = 'non_chord_tone') AS n_non_chord_tone FROM tagged WHERE tag <> 'no_chord_data' GROUP BY ALL HAVING count(*) >= 3)"""


def has(mask: Column, pitch: Column) -> Column:
    return F.call_function("shiftright", mask, F.pmod(pitch, F.lit(12)).cast("int")).bitwiseAND(F.lit(1)) == 1


def tagged_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every note with the segment sounding at its onset and one of three tags."""
    segs = music.segments(spark, d).where("mask is not null and end_us is not null").select("song", "start_us", "end_us", "mask")
    df = interval_as_of(music.notes(spark, d), segs, ["mask"])
    tag = F.when(F.col("mask").isNull(), "no_chord_data").when(has(F.col("mask"), F.col("pitch")), "chord_tone").otherwise("non_chord_tone")
    return df.withColumn("tag", tag)


@query("SELECT note_id, song, onset_us, pitch, pitch % 12 AS pitch_class, seg_start_us, seg_end_us, mask, tag FROM tagged", ("seg", "note"), (TAGGED_SQL,))
def tag_chord_tones(spark: SparkSession, d: str) -> DataFrame:
    return tagged_notes(spark, d).select("note_id", "song", "onset_us", "pitch", F.pmod("pitch", F.lit(12)).alias("pitch_class"), "seg_start_us", "seg_end_us", "mask", "tag")


def densities(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    df = tagged_notes(spark, d).where("tag <> 'no_chord_data'")
    return df.groupBy("song", "seg_start_us", "seg_end_us", "mask").agg(F.count("*").alias("n_notes"), F.count_if(F.col("tag") == "non_chord_tone").alias("n_non_chord_tone")).where(F.col("n_notes") >= least)


@query("SELECT song, seg_start_us, seg_end_us, n_notes, n_non_chord_tone, round(n_non_chord_tone / n_notes, 6) AS density, (n_non_chord_tone / n_notes >= 0.5) AS dense FROM density", ("seg", "note"), (TAGGED_SQL, DENSITY_SQL))
def rank_review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Segments of at least three notes by the share of notes outside the chord."""
    df = densities(spark, d).withColumn("density", F.round(F.col("n_non_chord_tone") / F.col("n_notes"), 6))
    df = df.select("song", "seg_start_us", "seg_end_us", "n_notes", "n_non_chord_tone", "density", (F.col("n_non_chord_tone") / F.col("n_notes") >= 0.5).alias("dense"))
    return df.orderBy(F.desc("density"), F.desc("n_notes"), "song", "seg_start_us")


@query("""SELECT CASE WHEN grouping(seg_start_us) = 0 THEN 'segment' ELSE 'song' END AS scope, song, seg_start_us, count(*) AS n_notes, count(*) FILTER (tag = 'non_chord_tone') AS n_non_chord_tone,
round(count(*) FILTER (tag = 'non_chord_tone') / count(*), 6) AS density FROM tagged WHERE tag <> 'no_chord_data' GROUP BY GROUPING SETS ((song, seg_start_us), (song)) HAVING count(*) >= 3""", ("seg", "note"), (TAGGED_SQL,))
def review_combined(spark: SparkSession, d: str) -> DataFrame:
    """Segments and whole songs in one ranking, told apart by scope."""
    df = tagged_notes(spark, d).where("tag <> 'no_chord_data'")
    both = df.groupingSets([["song", "seg_start_us"], ["song"]], "song", "seg_start_us").agg(F.when(F.grouping("seg_start_us") == 0, "segment").otherwise("song").alias("scope"), F.count("*").alias("n_notes"), F.count_if(F.col("tag") == "non_chord_tone").alias("n_non_chord_tone"))
    return both.where("n_notes >= 3").select("scope", "song", "seg_start_us", "n_notes", "n_non_chord_tone", F.round(F.col("n_non_chord_tone") / F.col("n_notes"), 6).alias("density"))


@query("SELECT song, count(*) AS n_notes, count(*) FILTER (tag = 'chord_tone') AS chord_tone, count(*) FILTER (tag = 'non_chord_tone') AS non_chord_tone, count(*) FILTER (tag = 'no_chord_data') AS no_chord_data, round(count(*) FILTER (tag = 'chord_tone') / count(*), 6) AS chord_tone_rate, round(count(*) FILTER (tag = 'non_chord_tone') / count(*), 6) AS non_chord_tone_rate FROM tagged GROUP BY song", ("seg", "note"), (TAGGED_SQL,))
def tag_rates(spark: SparkSession, d: str) -> DataFrame:
    tags = ("chord_tone", "non_chord_tone", "no_chord_data")
    df = tagged_notes(spark, d).groupBy("song").agg(F.count("*").alias("n_notes"), *(F.count_if(F.col("tag") == t).alias(t) for t in tags))
    return df.select("*", F.round(F.col("chord_tone") / F.col("n_notes"), 6).alias("chord_tone_rate"), F.round(F.col("non_chord_tone") / F.col("n_notes"), 6).alias("non_chord_tone_rate"))


@query("SELECT count(DISTINCT song) AS songs, count(*) AS n_notes, round(count(*) FILTER (tag = 'non_chord_tone') / count(*), 6) AS rate, CASE WHEN count(*) FILTER (tag = 'non_chord_tone') / count(*) > 0.20 THEN 'high' WHEN count(*) FILTER (tag = 'non_chord_tone') / count(*) > 0.15 THEN 'watch' ELSE '' END AS flag FROM tagged", ("seg", "note"), (TAGGED_SQL,))
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    """Weighted corpus rate with its watch or high flag."""
    df = tagged_notes(spark, d).groupBy("song").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "non_chord_tone").alias("out")).agg(F.count("*").alias("songs"), F.sum("n").alias("n_notes"), F.sum("out").alias("out"))
    rate = F.col("out") / F.col("n_notes")
    return df.select("songs", "n_notes", F.round(rate, 6).alias("rate"), F.when(rate > 0.20, "high").when(rate > 0.15, "watch").otherwise("").alias("flag"))


@query("""SELECT e.song, e.start_us AS seg_start_us, coalesce(t.n, 0) AS n, coalesce(t.n_out, 0) AS n_out, coalesce(round(t.n_out / t.n, 6), 0) AS density, coalesce(t.n_out / t.n >= 0.5, FALSE) AS dense, coalesce(t.notes, '') AS notes FROM (SELECT DISTINCT song, start_us FROM ends) e LEFT JOIN
(SELECT song, seg_start_us, count(*) AS n, count(*) FILTER (tag = 'non_chord_tone') AS n_out, array_to_string(list(CAST(pitch AS VARCHAR) || CASE WHEN tag = 'non_chord_tone' THEN '*' ELSE '' END ORDER BY onset_us, note_id), ' ') AS notes FROM tagged WHERE seg_start_us IS NOT NULL GROUP BY song, seg_start_us) t ON t.song = e.song AND t.seg_start_us = e.start_us""", ("seg", "note"), (TAGGED_SQL,))
def investigate_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment with its notes in time order, those outside the chord marked; empty segments have density 0."""
    mark = F.concat(F.col("pitch").cast("string"), F.when(F.col("tag") == "non_chord_tone", "*").otherwise(""))
    df = tagged_notes(spark, d).where("seg_start_us is not null").groupBy("song", "seg_start_us").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "non_chord_tone").alias("n_out"), F.array_sort(F.collect_list(F.struct("onset_us", "note_id", mark.alias("m")))).alias("x"))
    every = music.segments(spark, d).where("mask is not null and end_us is not null").select("song", F.col("start_us").alias("seg_start_us")).distinct()
    df, density = every.join(df, ["song", "seg_start_us"], "left"), F.col("n_out") / F.col("n")
    return df.select("song", "seg_start_us", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce(F.round(density, 6), F.lit(0.0)).alias("density"), F.coalesce(density >= 0.5, F.lit(False)).alias("dense"), F.coalesce(F.array_join(F.transform("x", lambda x: x.m), " "), F.lit("")).alias("notes"))


CHORDNOTES_SQL = "chordnote AS (SELECT song, idx, start_us, end_us, p.pc AS pc FROM seg, (SELECT unnest(range(12)) AS pc) p WHERE (mask >> p.pc) & 1 = 1)"


def chord_notes(spark: SparkSession, d: str) -> DataFrame:
    pcs = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: has(F.col("mask"), i))
    return music.segments(spark, d).where("mask is not null").select("song", "idx", "start_us", "end_us", F.explode(pcs).alias("pc"))


@query("SELECT song, idx, min(start_us) AS start_us, min(end_us) AS end_us, array_to_string(list_sort(list(DISTINCT pc)), ',') AS pitch_class_set FROM chordnote GROUP BY song, idx", ("seg",), (CHORDNOTES_SQL,))
def chord_segments(spark: SparkSession, d: str) -> DataFrame:
    """Chord notes assembled into one row a segment with its sorted set."""
    df = chord_notes(spark, d).groupBy("song", "idx").agg(F.min("start_us").alias("start_us"), F.min("end_us").alias("end_us"), F.array_sort(F.collect_set("pc")).alias("pcs"))
    return df.select("song", "idx", "start_us", "end_us", F.array_join(F.transform("pcs", lambda x: x.cast("string")), ",").alias("pitch_class_set"))


@query("""SELECT song, start_us, pc, CAST(sum(new) OVER (PARTITION BY song ORDER BY start_us, end_us NULLS FIRST, idx, pc ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS segment FROM
(SELECT *, CASE WHEN row(start_us, end_us) IS DISTINCT FROM lag(row(start_us, end_us)) OVER (PARTITION BY song ORDER BY start_us, end_us NULLS FIRST, idx, pc) THEN 1 ELSE 0 END AS new FROM chordnote)""", ("seg",), (CHORDNOTES_SQL,))
def segment_sessionize(spark: SparkSession, d: str) -> DataFrame:
    """Chord notes in time order, numbered by the change of (onset, offset): a note belongs to a new segment if either differs from the note before.

    In that order notes of one (onset, offset) are neighbours, so the segments are
    numbered by their keys and no note is compared with another.
    """
    keyed = chord_notes(spark, d).groupBy("song", "start_us", "end_us").agg(F.collect_list("pc").alias("pcs"))
    segs = with_context(keyed, "song", "start_us", "end_us", F.lit(1))
    return segs.select("song", "start_us", F.explode("pcs").alias("pc"), F.col("pos").alias("segment"))


@query("SELECT mask, any_value(cls) AS forte_class, bit_count(mask) AS cardinality, count(*) AS segment_count, count(DISTINCT song) AS song_count FROM seg WHERE mask IS NOT NULL GROUP BY mask", ("seg",))
def chord_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    df = music.segments(spark, d).where("mask is not null").groupBy("mask", "song").agg(F.first("cls").alias("cls"), F.count("*").alias("n"))  # the hot set is summed per song first
    df = df.groupBy("mask").agg(F.first("cls").alias("forte_class"), F.sum("n").alias("segment_count"), F.count("*").alias("song_count"))
    return df.select("mask", "forte_class", F.bit_count("mask").alias("cardinality"), "segment_count", "song_count").orderBy(F.desc("segment_count"), "mask")


@query("SELECT cls AS forte_class, count(*) AS segments, count(DISTINCT mask) AS sets, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM seg WHERE cls IS NOT NULL GROUP BY cls", ("seg",))
def chord_class_rollup(spark: SparkSession, d: str) -> DataFrame:
    df = music.segments(spark, d).where("cls is not null").groupBy("cls", "mask").agg(F.count("*").alias("n")).groupBy("cls").agg(F.sum("n").alias("segments"), F.count("*").alias("sets"))
    total = df.agg(F.sum("segments").alias("total"))  # one row
    return df.crossJoin(F.broadcast(total)).select(F.col("cls").alias("forte_class"), "segments", "sets", F.round(F.col("segments") / F.col("total"), 6).alias("share"))


@query("SELECT song, row_number() OVER (PARTITION BY song ORDER BY start_us, idx) - 1 AS segment_index, start_us, end_us, end_us - start_us AS duration_us, mask, cls AS canonical_chord_id, root AS root_pc FROM seg", ("seg",))
def chord_sequences(spark: SparkSession, d: str) -> DataFrame:
    df = with_context(music.segments(spark, d), "song", "start_us", "idx", F.lit(1))
    return df.select("song", F.col("pos").alias("segment_index"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "mask", F.col("cls").alias("canonical_chord_id"), F.col("root").alias("root_pc"))


@query("""SELECT mask, '{' || array_to_string(list_transform(list_filter(range(12), lambda i: (mask >> i) & 1 = 1), lambda i: list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], i + 1)), ',') || '}' AS chord,
array_to_string(list_filter(range(12), lambda i: (mask >> i) & 1 = 1), ',') AS pcs FROM (SELECT DISTINCT mask FROM seg WHERE mask IS NOT NULL)""", ("seg",))
def chord_set_format(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in PITCH_NAMES))
    df = music.segments(spark, d).where("mask is not null").select("mask").distinct()
    on = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: has(F.col("mask"), i))
    return df.select("mask", F.concat(F.lit("{"), F.array_join(F.transform(on, lambda i: F.get(names, i)), ","), F.lit("}")).alias("chord"), set_text(F.col("mask")).alias("pcs"))


# Names of the pitch classes.
PITCH_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


@query("SELECT pitch, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], pitch % 12 + 1) AS name, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], pitch % 12 + 1) || CAST(pitch // 12 - 1 AS VARCHAR) AS scientific, round(440 * pow(2, (pitch - 69) / 12), 4) AS hertz, round(69 + 12 * log2((440 * pow(2, (pitch - 69) / 12)) / 440), 4) AS midi FROM (SELECT DISTINCT pitch FROM note)", ("note",))
def pitch_names(spark: SparkSession, d: str) -> DataFrame:
    """Names and frequencies of the pitches in use, and the frequency's pitch again."""
    names = F.array(*(F.lit(n) for n in PITCH_NAMES))
    name, hertz = F.get(names, F.pmod("pitch", F.lit(12))), F.lit(440) * F.pow(F.lit(2.0), (F.col("pitch") - 69) / 12)
    return music.notes(spark, d).select("pitch").distinct().select("pitch", name.alias("name"), F.concat(name, (F.floor(F.col("pitch") / 12) - 1).cast("string")).alias("scientific"), F.round(hertz, 4).alias("hertz"), F.round(69 + 12 * F.log2(hertz / 440), 4).alias("midi"))
