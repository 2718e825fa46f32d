"""Correction, proposals, export and consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.operators import correction as op
from cantus.operators.ordered import with_context
from cantus.plans.harmony import PITCH_NAMES, TAGGED_SQL, has, tagged_notes
from cantus.plans.registry import query
from cantus.plans.storage import cut, table
from cantus.sources import music

STUCK_SQL = """
owned AS (SELECT song, seg_start_us, list(DISTINCT pitch) FILTER (tag = 'chord_tone') AS tones FROM tagged WHERE seg_start_us IS NOT NULL GROUP BY song, seg_start_us),
owned_before AS (SELECT song, seg_start_us, lag(tones) OVER (PARTITION BY song ORDER BY seg_start_us) AS tones FROM owned),
placed AS (SELECT *, row_number() OVER w - 1 AS pos, lag(pitch) OVER w AS p_before, lead(pitch) OVER w AS p_after FROM tagged WINDOW w AS (PARTITION BY song ORDER BY onset_us, note_id)),
averaged AS (SELECT *, CASE WHEN p_before IS NULL AND p_after IS NULL THEN NULL ELSE (coalesce(p_before, 0) + coalesce(p_after, 0)) / ((p_before IS NOT NULL)::INT + (p_after IS NOT NULL)::INT) END AS average FROM placed),
stuck AS (SELECT a.* FROM averaged a JOIN owned_before b ON a.song = b.song AND a.seg_start_us = b.seg_start_us WHERE a.tag = 'non_chord_tone' AND list_contains(b.tones, a.pitch)),
aimed AS (SELECT * FROM (SELECT s.*, CAST(s.pitch + m.m AS INT) AS target, row_number() OVER (PARTITION BY note_id ORDER BY abs(m.m), coalesce(abs(s.pitch + m.m - s.average), 0), m.m) AS k
  FROM stuck s, (SELECT unnest(range(-6, 7)) AS m) m WHERE (s.mask >> CAST((s.pitch + m.m) % 12 AS INT)) & 1 = 1) WHERE k = 1),
pairs AS (SELECT a.note_id, a.target, b.note_id AS other_id, b.pos < a.pos AS earlier, b.pitch AS b_pitch, c.target AS b_target FROM aimed a JOIN placed b ON a.song = b.song AND a.note_id <> b.note_id AND b.onset_us < a.offset_us AND a.onset_us < b.offset_us LEFT JOIN aimed c ON c.note_id = b.note_id
  WHERE b.pitch = a.target OR c.target = a.target),
blocked AS (SELECT DISTINCT note_id FROM pairs WHERE b_pitch = target AND (NOT earlier OR b_target IS NULL)),
chain AS (SELECT * FROM pairs WHERE earlier AND b_target IS NOT NULL),
s0 AS (SELECT note_id, note_id NOT IN (SELECT note_id FROM blocked) AS moved FROM aimed)"""
ROUNDS = [f"s{k} AS (SELECT note_id, note_id NOT IN (SELECT note_id FROM blocked) AND note_id NOT IN (SELECT c.note_id FROM chain c JOIN s{k - 1} p ON p.note_id = c.other_id WHERE CASE WHEN p.moved THEN c.b_target ELSE c.b_pitch END = c.target) AS moved FROM aimed)" for k in range(1, 9)]
FIXED_SQL = (TAGGED_SQL, STUCK_SQL, *ROUNDS, "fixed AS (SELECT a.*, s8.moved FROM aimed a JOIN s8 ON s8.note_id = a.note_id), now AS (SELECT p.*, f.target, coalesce(f.moved, FALSE) AS was_corrected, CASE WHEN f.moved THEN f.target ELSE p.pitch END AS pitch_now FROM placed p LEFT JOIN fixed f ON f.note_id = p.note_id)")


def _now(spark: SparkSession, d: str) -> DataFrame:
    """All notes after the pass: pitch_now, was_corrected."""
    tagged = cut(tagged_notes(spark, d))
    done = op.corrected(tagged).select("note_id", "target", "moved")
    df = tagged.join(done, "note_id", "left")
    return df.withColumn("was_corrected", F.coalesce("moved", F.lit(False))).withColumn("pitch_now", F.when(F.col("was_corrected"), F.col("target")).otherwise(F.col("pitch"))).drop("moved")


@query("SELECT note_id, song, seg_start_us, pitch, target, target - pitch AS moved_by FROM aimed", ("seg", "note"), (TAGGED_SQL, STUCK_SQL))
def stuck_pitch(spark: SparkSession, d: str) -> DataFrame:
    """Notes that keep a tone of the previous chord, and the nearest tone of their own."""
    return op.stuck(cut(tagged_notes(spark, d))).select("note_id", "song", "seg_start_us", "pitch", "target", (F.col("target") - F.col("pitch")).alias("moved_by"))


@query("SELECT note_id, song, onset_us, pitch AS original_pitch, target AS corrected_pitch, moved FROM fixed", ("seg", "note"), FIXED_SQL)
def corrections(spark: SparkSession, d: str) -> DataFrame:
    """The collision-aware pass in note order: which stuck notes move."""
    return op.corrected(cut(tagged_notes(spark, d))).select("note_id", "song", "onset_us", F.col("pitch").alias("original_pitch"), F.col("target").alias("corrected_pitch"), "moved")


@query("SELECT target - pitch AS semitones, CASE WHEN abs(target - pitch) >= 5 THEN '5+' ELSE CAST(abs(target - pitch) AS VARCHAR) END AS bucket, count(*) AS n FROM fixed WHERE moved GROUP BY ALL", ("seg", "note"), FIXED_SQL)
def semitone_histogram(spark: SparkSession, d: str) -> DataFrame:
    by = (F.col("target") - F.col("pitch")).alias("semitones")
    df = op.corrected(cut(tagged_notes(spark, d))).where("moved").groupBy(by).agg(F.count("*").alias("n"))
    return df.select("semitones", F.when(F.abs("semitones") >= 5, "5+").otherwise(F.abs("semitones").cast("string")).alias("bucket"), "n")


@query("""SELECT count(*) AS corrections, round(avg(d), 4) AS mean, median(d) AS median, max(d) AS largest, round(count(*) FILTER (d >= 5) / count(*), 6) AS five_or_more, coalesce(count(*) FILTER (d >= 5) / count(*) > 0.10, FALSE) AS flagged FROM (SELECT abs(target - pitch) AS d FROM fixed WHERE moved)""", ("seg", "note"), FIXED_SQL)
def distance_summary(spark: SparkSession, d: str) -> DataFrame:
    """Semitones moved over all corrections; flagged if more than a tenth moved five or more. The distances are at most 6, so the median needs seven counts."""
    df = op.corrected(cut(tagged_notes(spark, d))).where("moved").groupBy(F.abs(F.col("target") - F.col("pitch")).alias("d")).agg(F.count("*").alias("n"))
    five = F.try_divide(F.sum(F.when(F.col("d") >= 5, F.col("n")).otherwise(0)), F.sum("n"))
    return df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("corrections"), F.round(F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")), 4).alias("mean"), F.percentile("d", 0.5, F.col("n")).alias("median"), F.max("d").alias("largest"), F.round(five, 6).alias("five_or_more"), F.coalesce(five > 0.10, F.lit(False)).alias("flagged"))


PROPOSED_SQL = """
seen AS (SELECT *, lag(pitch_now) OVER w AS q_before, lead(pitch_now) OVER w AS q_after FROM now WINDOW w AS (PARTITION BY song ORDER BY onset_us, note_id)),
proposed AS (SELECT * FROM (SELECT s.*, CAST(s.pitch_now + m.m AS INT) AS nearest, row_number() OVER (PARTITION BY note_id ORDER BY abs(m.m), coalesce(abs(s.pitch_now + m.m - CASE WHEN q_before IS NULL AND q_after IS NULL THEN NULL ELSE (coalesce(q_before, 0) + coalesce(q_after, 0)) / ((q_before IS NOT NULL)::INT + (q_after IS NOT NULL)::INT) END), 0), m.m) AS k
  FROM seen s, (SELECT unnest(range(-6, 7)) AS m) m WHERE s.tag = 'non_chord_tone' AND NOT s.was_corrected AND (s.mask >> CAST((s.pitch_now + m.m) % 12 AS INT)) & 1 = 1) WHERE k = 1)"""


def _proposals(now: DataFrame) -> DataFrame:
    df = with_context(now, "song", "onset_us", "note_id", F.col("pitch_now"), before=1, after=1)
    near = F.array_compact(F.array(F.get("prev", F.lit(0)), F.get("next", F.lit(0))))
    df = df.withColumn("average", F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near))).where("tag = 'non_chord_tone' and not was_corrected")
    return df.withColumn("nearest", op.nearest_tone(F.col("pitch_now"), F.col("mask"), F.col("average")))


@query("""SELECT note_id, song, onset_us, (offset_us - onset_us) // 1000 AS duration_ms, pitch_now AS current_pitch, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], pitch_now % 12 + 1) || CAST(pitch_now // 12 - 1 AS VARCHAR) AS current_name, nearest,
nearest - pitch_now AS semitones, CASE WHEN offset_us - onset_us > 100000 THEN 'correct' ELSE 'keep' END AS action FROM proposed""", ("seg", "note"), (*FIXED_SQL, PROPOSED_SQL))
def proposals(spark: SparkSession, d: str) -> DataFrame:
    """The other notes outside their chord with the nearest tone; short ones are kept by default."""
    names = F.array(*(F.lit(n) for n in PITCH_NAMES))
    name = F.concat(F.get(names, F.pmod("pitch_now", F.lit(12))), (F.floor(F.col("pitch_now") / 12) - 1).cast("string"))
    return _proposals(_now(spark, d)).select("note_id", "song", "onset_us", F.expr("(offset_us - onset_us) div 1000").alias("duration_ms"), F.col("pitch_now").alias("current_pitch"), name.alias("current_name"), "nearest", (F.col("nearest") - F.col("pitch_now")).alias("semitones"), F.when(F.col("offset_us") - F.col("onset_us") > 100000, "correct").otherwise("keep").alias("action"))


@query("""SELECT n.note_id, n.song, n.onset_us, n.offset_us, n.pitch_now AS pitch, n.velocity, n.seg_start_us, n.seg_end_us, n.mask, n.song IN (SELECT song FROM fixed WHERE moved) AS used_corrected,
l.song IS NOT NULL AS was_corrected, CASE WHEN l.song IS NOT NULL THEN 'stuck_pitch' END AS correction_type, l.pitch AS original_pitch FROM now n LEFT JOIN
(SELECT song, onset_us, target, pitch FROM fixed WHERE moved QUALIFY row_number() OVER (PARTITION BY song, onset_us, target ORDER BY pos DESC) = 1) l ON l.song = n.song AND l.onset_us = n.onset_us AND l.target = n.pitch_now""", ("seg", "note"), FIXED_SQL)
def note_events_export(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their chord and the changelog joined on song, onset and corrected pitch.

    A song's corrected notes are used if it has any correction, else its merged ones.
    """
    now = cut(_now(spark, d))
    moved = now.where("was_corrected")
    log = op.last_entries(moved.select("song", "onset_us", F.col("pitch_now").alias("corrected_pitch"), F.col("pitch").alias("original_pitch"), F.col("note_id").alias("place")))
    used = moved.groupBy("song").agg(F.lit(True).alias("used"))
    merged = now.select("note_id", "song", "onset_us", "offset_us", F.col("pitch").alias("merged_pitch"), F.when(F.col("was_corrected"), F.col("pitch_now")).alias("corrected"), "velocity", "seg_start_us", "seg_end_us", "mask").join(used, "song", "left")
    notes = merged.withColumn("pitch", F.coalesce(F.when(F.col("used"), F.col("corrected")), F.col("merged_pitch")))
    df = notes.join(log.withColumnRenamed("corrected_pitch", "pitch"), ["song", "onset_us", "pitch"], "left")
    hit = F.col("original_pitch").isNotNull()
    return df.select("note_id", "song", "onset_us", "offset_us", "pitch", "velocity", "seg_start_us", "seg_end_us", "mask", F.coalesce("used", F.lit(False)).alias("used_corrected"), hit.alias("was_corrected"), F.when(hit, "stuck_pitch").alias("correction_type"), "original_pitch")


SUMMARY_SQL = """
summary AS (SELECT p.song, count(*) AS n_notes, count(*) FILTER (was_corrected) AS corrected, count(*) FILTER (target IS NOT NULL AND NOT was_corrected) AS skipped, count(*) FILTER (tag = 'chord_tone') AS inside, count(*) FILTER (tag = 'non_chord_tone') AS outside, count(*) FILTER (tag = 'no_chord_data') AS no_chord_data,
round(count(*) FILTER (was_corrected) / count(*), 4) AS rate, round(avg(abs(target - pitch)) FILTER (was_corrected), 2) AS mean_distance, count(*) FILTER (was_corrected AND abs(target - pitch) <= 2) AS moved_1_2, count(*) FILTER (was_corrected AND abs(target - pitch) BETWEEN 3 AND 4) AS moved_3_4, count(*) FILTER (was_corrected AND abs(target - pitch) >= 5) AS moved_5_up,
CASE WHEN count(*) FILTER (was_corrected) > 0 THEN 'ok' ELSE 'ok_no_corrections' END AS status, count(*) FILTER (was_corrected) = 0 AND count(*) FILTER (tag <> 'no_chord_data') = 0 AS suspicious_zero FROM now p GROUP BY p.song)"""


def _summary(now: DataFrame) -> DataFrame:
    distance = F.when(F.col("was_corrected"), F.abs(F.col("target") - F.col("pitch")))
    df = now.groupBy("song").agg(
        F.count("*").alias("n_notes"), F.count_if("was_corrected").alias("corrected"), F.count_if(F.col("target").isNotNull() & ~F.col("was_corrected")).alias("skipped"),
        *(F.count_if(F.col("tag") == t).alias(c) for t, c in (("chord_tone", "inside"), ("non_chord_tone", "outside"), ("no_chord_data", "no_chord_data"))),
        F.round(F.avg(distance), 2).alias("mean_distance"), F.count_if(distance <= 2).alias("moved_1_2"), F.count_if(distance.between(3, 4)).alias("moved_3_4"), F.count_if(distance >= 5).alias("moved_5_up"),
    )
    return df.withColumns({"rate": F.round(F.col("corrected") / F.col("n_notes"), 4), "status": F.when(F.col("corrected") > 0, "ok").otherwise("ok_no_corrections"), "suspicious_zero": (F.col("corrected") == 0) & (F.col("inside") + F.col("outside") == 0)})


@query("""SELECT s.*, coalesce(p.n, 0) AS proposals, coalesce(p.yes, 0) AS proposals_correct, coalesce(p.n - p.yes, 0) AS proposals_keep FROM summary s LEFT JOIN (SELECT song, count(*) AS n, count(*) FILTER (offset_us - onset_us > 100000) AS yes FROM proposed GROUP BY song) p ON p.song = s.song""", ("seg", "note"), (*FIXED_SQL, PROPOSED_SQL, SUMMARY_SQL))
def correction_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per song: tags, corrections by distance, and proposals by their default action."""
    now = cut(_now(spark, d))
    proposed = _proposals(now).groupBy("song").agg(F.count("*").alias("proposals"), F.count_if(F.col("offset_us") - F.col("onset_us") > 100000).alias("proposals_correct"))
    df = _summary(now).join(proposed, "song", "left").na.fill(0, ["proposals", "proposals_correct"])
    return df.withColumn("proposals_keep", F.col("proposals") - F.col("proposals_correct"))


@query("SELECT song, corrected, n_notes, rate FROM summary WHERE status = 'ok' ORDER BY corrected / n_notes DESC, song LIMIT 10", ("seg", "note"), (*FIXED_SQL, SUMMARY_SQL))
def top_correction_rates(spark: SparkSession, d: str) -> DataFrame:
    """The ten songs with most corrections a note (the report's length is its feature)."""
    return _summary(_now(spark, d)).where("status = 'ok'").orderBy(F.desc(F.col("corrected") / F.col("n_notes")), "song").limit(10).select("song", "corrected", "n_notes", "rate")


@query("""SELECT e.song, CASE WHEN p.song IS NOT NULL THEN 'ok' WHEN f.song IS NOT NULL THEN 'failed' ELSE 'not_processed' END AS status FROM (SELECT DISTINCT song FROM (SELECT song FROM seg UNION SELECT song FROM gt)) e
LEFT JOIN (SELECT DISTINCT song FROM tagged WHERE tag = 'non_chord_tone') p ON p.song = e.song LEFT JOIN (SELECT DISTINCT song FROM chord_review_candidates WHERE segment_index IS NOT NULL AND (density IS NULL OR isnan(density))) f ON f.song = e.song""", ("seg", "note", "gt"), (TAGGED_SQL,))
def song_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Songs with segments or annotations: processed (some note lies outside its chord), failed (a segment could not be scored) or neither."""
    eligible = music.segments(spark, d).select("song").union(music.annotations(spark, d).select("song"))
    failed = table(spark, d, "chord_review_candidates").where("song is not null and segment_index is not null and (density is null or isnan(density))")
    return op.song_status(eligible, tagged_notes(spark, d).where("tag = 'non_chord_tone'"), failed)


@query("""SELECT song, round(before / n, 4) AS before_rate, round(after / n, 4) AS after_rate, CASE WHEN after / n > 0.20 THEN 'high' WHEN after / n > 0.15 THEN 'watch' ELSE '' END AS flag FROM
(SELECT song, count(*) AS n, count(*) FILTER (tag = 'non_chord_tone') AS before, count(*) FILTER (mask IS NOT NULL AND (mask >> CAST(pitch_now % 12 AS INT)) & 1 = 0) AS after FROM now GROUP BY song)""", ("seg", "note"), FIXED_SQL)
def before_after(spark: SparkSession, d: str) -> DataFrame:
    """Share of notes outside the chord before and after the pass, with its flag."""
    df = _now(spark, d).groupBy("song").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "non_chord_tone").alias("b"), F.count_if(F.col("mask").isNotNull() & ~has(F.col("mask"), F.col("pitch_now"))).alias("a"))
    rate = F.col("a") / F.col("n")
    return df.select("song", F.round(F.col("b") / F.col("n"), 4).alias("before_rate"), F.round(rate, 4).alias("after_rate"), F.when(rate > 0.20, "high").when(rate > 0.15, "watch").otherwise("").alias("flag")).orderBy(F.desc("after_rate"), "song")


@query("""SELECT song, place, note_id, unnest(list_filter(['changed without an entry', 'entry with another pitch', 'corrected outside the chord', 'entry without a change'], lambda x, i: CASE i WHEN 1 THEN changed AND entry IS NULL WHEN 2 THEN changed AND entry <> pitch_now WHEN 3 THEN changed AND (mask >> CAST(pitch_now % 12 AS INT)) & 1 = 0 ELSE NOT changed AND entry IS NOT NULL END)) AS problem FROM
(SELECT n.song, n.pos AS place, n.note_id, n.pitch_now <> n.pitch AS changed, n.pitch_now, n.mask, (SELECT arg_min(a.target, struct_pack(t := a.onset_us, p := a.target)) FROM aimed a WHERE a.song = n.song AND a.pitch = n.pitch AND a.onset_us BETWEEN n.onset_us - 100 AND n.onset_us + 100) AS entry FROM now n)""", ("seg", "note"), FIXED_SQL)
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The merged notes, the notes after the collision-aware pass, and the changelog of a pass that ignores collisions: where they disagree."""
    now = cut(_now(spark, d))
    merged = now.select("song", F.col("note_id").alias("id"), "onset_us", "pitch", "mask")
    after = now.select("song", F.col("note_id").alias("id"), "onset_us", F.col("pitch_now").alias("pitch"))
    log = now.where("target is not null").select("song", "onset_us", F.col("pitch").alias("original_pitch"), F.col("target").alias("corrected_pitch"))
    return op.reconcile(merged, after, log)


@query("""SELECT 'corrected_outside_chord' AS rule, count(*) FILTER (was_corrected AND (mask >> CAST(pitch_now % 12 AS INT)) & 1 = 0) AS n FROM now UNION ALL SELECT 'changed_without_log', count(*) FILTER (NOT was_corrected AND pitch_now <> pitch) FROM now
UNION ALL SELECT 'log_without_note', count(*) FROM fixed f WHERE f.moved AND NOT EXISTS (SELECT 1 FROM now n WHERE n.song = f.song AND n.pitch_now = f.target AND abs(n.onset_us - f.onset_us) <= 100) UNION ALL SELECT 'unpaired', 0""", ("seg", "note"), FIXED_SQL)
def consistency_check(spark: SparkSession, d: str) -> DataFrame:
    """Merged notes, corrected notes and the log against each other: four rules, each with its number of breaches."""
    now = cut(_now(spark, d))
    log = now.where("was_corrected").select("song", F.col("onset_us").alias("t"), F.col("pitch_now").alias("pitch_now"), F.monotonically_increasing_id().alias("log_id"))
    near = log.join(now.select("song", "pitch_now", "onset_us"), ["song", "pitch_now"]).where(F.abs(F.col("onset_us") - F.col("t")) <= 100).select("log_id").distinct()
    merged, after = now.select("song", "note_id", "onset_us", "pitch"), now.select("song", F.col("note_id").alias("note_id"), F.col("onset_us").alias("onset_us"), "pitch_now")
    pairs = op.zip_by_rank(merged, after, "song", "onset_us", "note_id")
    rules = now.agg(F.count_if(F.col("was_corrected") & ~has(F.col("mask"), F.col("pitch_now"))).alias("corrected_outside_chord"), F.count_if(~F.col("was_corrected") & (F.col("pitch_now") != F.col("pitch"))).alias("changed_without_log"))
    rules = rules.crossJoin(log.join(near, "log_id", "left_anti").agg(F.count("*").alias("log_without_note"))).crossJoin(pairs.agg(F.count_if(F.col("a.note_id").isNull() | F.col("b.note_id").isNull() | (F.abs(F.col("a.onset_us") - F.col("b.onset_us")) > 100)).alias("unpaired")))
    names = ("corrected_outside_chord", "changed_without_log", "log_without_note", "unpaired")
    return rules.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.rule", "x.n")
