"""Ranges and windows of a song."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.operators.correction import corrected
from cantus.operators.ordered import densest_windows, with_context
from cantus.plans.correction import FIXED_SQL
from cantus.plans.harmony import TAGGED_SQL, tagged_notes
from cantus.plans.registry import query
from cantus.plans.storage import cut
from cantus.sources import music

DENSE_SQL = """
logged AS (SELECT song, onset_us FROM fixed WHERE moved),
ended AS (SELECT song, onset_us, count(*) OVER w AS n, min(onset_us) OVER w AS first_us FROM logged WINDOW w AS (PARTITION BY song ORDER BY onset_us RANGE BETWEEN 20000000 PRECEDING AND CURRENT ROW)),
dense AS (SELECT song, arg_min(first_us, struct_pack(a := -n, b := onset_us)) AS from_us, arg_min(onset_us, struct_pack(a := -n, b := onset_us)) AS to_us, max(n) AS n FROM ended GROUP BY song)"""


@query("SELECT song, from_us, to_us, n FROM dense", ("seg", "note"), (*FIXED_SQL, DENSE_SQL))
def densest_window(spark: SparkSession, d: str) -> DataFrame:
    """Per song the most corrections within 20 seconds, from the first to the last of them; the earliest wins."""
    log = corrected(cut(tagged_notes(spark, d))).where("moved").select("song", "onset_us")
    return densest_windows(log, 20_000_000)


@query("""SELECT n.song, CASE WHEN dense.song IS NULL THEN 0 ELSE greatest(0, from_us - 3000000) END AS view_from_us, CASE WHEN dense.song IS NULL THEN least(30000000, max(onset_us) + 1000000) ELSE to_us + 3000000 END AS view_to_us
FROM note n LEFT JOIN dense ON dense.song = n.song GROUP BY n.song, dense.song, from_us, to_us""", ("seg", "note"), (*FIXED_SQL, DENSE_SQL))
def default_view(spark: SparkSession, d: str) -> DataFrame:
    """The densest corrections with three seconds around them, or the song's first 30 seconds."""
    tagged = cut(tagged_notes(spark, d))
    dense = densest_windows(corrected(tagged).where("moved").select("song", "onset_us"), 20_000_000)
    df = tagged.groupBy("song").agg(F.max("onset_us").alias("last")).join(dense, "song", "left")
    return df.select("song", F.when(F.col("from_us").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("from_us") - 3_000_000)).alias("view_from_us"), F.when(F.col("from_us").isNull(), F.least(F.lit(30_000_000), F.col("last") + 1_000_000)).otherwise(F.col("to_us") + 3_000_000).alias("view_to_us"))


@query("""SELECT song, mode, from_us, to_us, n_notes, n_outside, round(n_outside / n_notes, 6) AS density FROM (SELECT *, row_number() OVER (PARTITION BY song, mode ORDER BY n_notes >= 15 DESC, CASE mode WHEN 'max' THEN -n_outside / n_notes ELSE n_outside / n_notes END, n_notes DESC, from_us, to_us) AS k FROM
(SELECT w.song, w.from_us, w.to_us, count(*) AS n_notes, count(*) FILTER (t.tag = 'non_chord_tone') AS n_outside FROM
(SELECT a.song, a.start_us AS from_us, b.end_us AS to_us FROM seg a JOIN seg b ON a.song = b.song AND b.start_us >= a.start_us AND b.end_us - a.start_us BETWEEN 20000000 AND 30000000) w
JOIN tagged t ON t.song = w.song AND t.onset_us >= w.from_us AND t.onset_us < w.to_us AND t.tag <> 'no_chord_data' GROUP BY ALL), (SELECT unnest(['max', 'min']) AS mode)) WHERE k = 1""", ("seg", "note"), (TAGGED_SQL,))
def best_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Per song the runs of segments of 20 to 30 seconds with the most and the least dense disagreement; at least 15 notes if any run has them.

    Both range joins meet in time cells of 30 seconds. Notes are counted by cumulative
    counts at the two ends of a run, not by joining every note to every run.
    """
    segs = cut(music.segments(spark, d).where("end_us is not null").select("song", "idx", "start_us", "end_us"))
    tagged = cut(tagged_notes(spark, d).where("tag <> 'no_chord_data'").select("song", "note_id", "onset_us", "tag"))
    # cumulative counts of notes before each border, in one ordered pass of notes and borders
    borders = segs.select("song", F.col("start_us").alias("t")).union(segs.select("song", "end_us")).distinct()
    line = tagged.select("song", F.col("onset_us").alias("t"), F.lit(1).alias("kind"), F.lit(1).alias("n"), (F.col("tag") == "non_chord_tone").cast("int").alias("o"), "note_id").unionByName(borders.withColumn("kind", F.lit(0)).withColumn("n", F.lit(0)).withColumn("o", F.lit(0)).withColumn("note_id", F.lit(None).cast("bigint")))
    line = line.withColumn("key", F.struct("kind", "note_id"))
    upto = with_context(line, "song", "t", "key", F.lit(1), running=F.col("n").cast("bigint") * 1_000_000_000 + F.col("o")).where("kind = 0").select("song", "t", F.expr("running div 1000000000").alias("notes"), F.expr("running % 1000000000").alias("outside"))
    cell = 30_000_000
    a = segs.select("song", F.col("start_us").alias("from_us"), F.explode(F.array(F.floor(F.col("start_us") / cell), F.floor(F.col("start_us") / cell) + 1)).alias("cell"))
    b = segs.select("song", F.col("start_us").alias("b_start"), F.col("end_us").alias("to_us"), F.floor(F.col("end_us") / cell).alias("cell"))
    runs = a.join(b, ["song", "cell"]).where("b_start >= from_us and to_us - from_us between 20000000 and 30000000").select("song", "from_us", "to_us")
    at = lambda s: upto.select("song", F.col("t").alias(f"{s}_us"), F.col("notes").alias(f"{s}_n"), F.col("outside").alias(f"{s}_o"))
    scored = runs.join(at("from"), ["song", "from_us"]).join(at("to"), ["song", "to_us"]).select("song", "from_us", "to_us", (F.col("to_n") - F.col("from_n")).alias("n_notes"), (F.col("to_o") - F.col("from_o")).alias("n_outside")).where("n_notes > 0")
    density = F.col("n_outside") / F.col("n_notes")
    order = lambda sign: F.struct((F.col("n_notes") >= 15).alias("enough"), (sign * density).alias("density"), F.col("n_notes").alias("n"), (-F.col("from_us")).alias("f"), (-F.col("to_us")).alias("t"))
    best = lambda sign, mode: F.struct(F.lit(mode).alias("mode"), F.max_by(F.struct("from_us", "to_us", "n_notes", "n_outside"), order(sign)).alias("x"))
    both = scored.groupBy("song").agg(F.array(best(1.0, "max"), best(-1.0, "min")).alias("b")).select("song", F.explode("b").alias("b"))
    return both.select("song", "b.mode", "b.x.*").withColumn("density", F.round(density, 6))


@query("""SELECT song, onset_us AS at_us, 'note' AS kind, CAST(pitch AS VARCHAR) AS what FROM tagged WHERE onset_us >= 10000000 AND onset_us < 20000000 UNION ALL
SELECT song, start_us, 'segment', array_to_string(list_filter(range(12), lambda i: (mask >> i) & 1 = 1), ',') FROM seg WHERE end_us > 10000000 AND start_us < 20000000 AND mask IS NOT NULL""", ("seg", "note"), (TAGGED_SQL,))
def inspect_range(spark: SparkSession, d: str) -> DataFrame:
    """Seconds 10 to 20 of every song: notes that start there and segments that reach into it, on one line of time."""
    from cantus.functions.chords import set_text

    notes = tagged_notes(spark, d).where("onset_us >= 10000000 and onset_us < 20000000").select("song", F.col("onset_us").alias("at_us"), F.lit("note").alias("kind"), F.col("pitch").cast("string").alias("what"))
    segs = music.segments(spark, d).where("end_us > 10000000 and start_us < 20000000 and mask is not null").select("song", F.col("start_us").alias("at_us"), F.lit("segment").alias("kind"), set_text(F.col("mask")).alias("what"))
    return notes.unionByName(segs).orderBy("song", "at_us", "kind")


@query("SELECT song, note_id, pitch, onset_us - 15000000 AS start_us, least(offset_us, 40000000) - 15000000 AS end_us FROM note WHERE onset_us >= 15000000 AND onset_us < 40000000", ("note",))
def midi_slice(spark: SparkSession, d: str) -> DataFrame:
    """Seconds 15 to 40 of every song as a slice of its own: times shifted, ends clipped."""
    return music.notes(spark, d).where("onset_us >= 15000000 and onset_us < 40000000").select("song", "note_id", "pitch", (F.col("onset_us") - 15_000_000).alias("start_us"), (F.least("offset_us", F.lit(40_000_000)) - 15_000_000).alias("end_us"))


@query("""SELECT arg_min(song, struct_pack(a := -d, b := song)) AS highest, arg_max(song, struct_pack(a := -d, b := song)) AS lowest, count(*) AS songs, count(*) < 10 AS few FROM (SELECT song, count(*) FILTER (tag = 'non_chord_tone') / count(*) AS d FROM tagged WHERE tag <> 'no_chord_data' GROUP BY song HAVING count(*) >= 3)""", ("seg", "note"), (TAGGED_SQL,))
def anchor_songs(spark: SparkSession, d: str) -> DataFrame:
    """The songs with the highest and the lowest density."""
    df = tagged_notes(spark, d).where("tag <> 'no_chord_data'").groupBy("song").agg((F.count_if(F.col("tag") == "non_chord_tone") / F.count("*")).alias("d"), F.count("*").alias("n")).where("n >= 3")
    key = F.struct((-F.col("d")).alias("a"), "song")
    return df.agg(F.min_by("song", key).alias("highest"), F.max_by("song", key).alias("lowest"), F.count("*").alias("songs")).withColumn("few", F.col("songs") < 10)


@query("""SELECT song, written, CASE WHEN contains(written, ':') THEN CAST(split_part(written, ':', 1) AS DOUBLE) * 60 + CAST(split_part(written, ':', 2) AS DOUBLE) ELSE CAST(written AS DOUBLE) END AS seconds FROM
(SELECT song, CASE WHEN start_us >= 60000000 THEN CAST(start_us // 60000000 AS VARCHAR) || ':' || lpad(CAST(start_us // 1000000 % 60 AS VARCHAR), 2, '0') ELSE CAST(start_us // 1000000 AS VARCHAR) END || '.' || lpad(CAST(start_us // 1000 % 1000 AS VARCHAR), 3, '0') AS written FROM seg)""", ("seg",))
def parse_times(spark: SparkSession, d: str) -> DataFrame:
    """Segment starts written as seconds or minutes and seconds, to the millisecond, and read again."""
    whole = F.when(F.col("start_us") >= 60_000_000, F.concat(F.expr("start_us div 60000000").cast("string"), F.lit(":"), F.lpad(F.expr("start_us div 1000000 % 60").cast("string"), 2, "0"))).otherwise(F.expr("start_us div 1000000").cast("string"))
    written = F.concat(whole, F.lit("."), F.lpad(F.expr("start_us div 1000 % 1000").cast("string"), 3, "0"))
    return music.segments(spark, d).select("song", written.alias("written")).select("song", "written", time_of(F.col("written")).alias("seconds"))


def time_of(text):
    """Seconds of ``M:SS(.mmm)`` or plain seconds; NULL if it is neither."""
    minutes, rest = F.substring_index(text, ":", 1).try_cast("double"), F.substring_index(text, ":", -1).try_cast("double")
    return F.when(F.instr(text, ":") > 0, minutes * 60 + rest).otherwise(text.try_cast("double"))


