"""Stuck pitches: which notes keep a tone of the previous chord, where they should go, and the collision-aware pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.operators.ordered import with_context
from cantus.plans.storage import cut

PAIR_BLOCK_US = 4_000_000


def nearest_tone(pitch: Column, mask: Column, average: Column) -> Column:
    """The chord tone nearest to ``pitch``; ties go to the one closest to ``average``, then to the lower."""
    targets = F.filter(F.sequence(pitch - 6, pitch + 6), lambda t: F.call_function("shiftright", mask, F.pmod(t, F.lit(12)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    ranked = F.transform(targets, lambda t: F.struct(F.abs(t - pitch).alias("d"), F.coalesce(F.abs(t - average), F.lit(0.0)).alias("e"), t.alias("t")))
    return F.array_min(ranked).t


def stuck(tagged: DataFrame) -> DataFrame:
    """Non-chord notes whose exact pitch is a chord tone of the segment before (of those that own a note), with their target.

    Columns of ``tagged`` plus pos, average (of the neighbouring pitches) and target.
    """
    owned = tagged.where("seg_start_us is not null").groupBy("song", "seg_start_us").agg(F.array_distinct(F.collect_set(F.when(F.col("tag") == "chord_tone", F.col("pitch")))).alias("tones"))
    before = with_context(owned, "song", "seg_start_us", "tones", F.col("tones"), before=1, block_us=600_000_000).select("song", "seg_start_us", F.get("prev", F.lit(0)).alias("tones_before"))
    placed = with_context(tagged, "song", "onset_us", "note_id", F.col("pitch"), before=1, after=1)
    near = F.array_compact(F.array(F.get("prev", F.lit(0)), F.get("next", F.lit(0))))
    placed = placed.withColumn("average", F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near))).drop("prev", "next")
    hit = placed.where("tag = 'non_chord_tone'").join(before, ["song", "seg_start_us"]).where(F.array_contains("tones_before", F.col("pitch"))).drop("tones_before")
    return hit.withColumn("target", nearest_tone(F.col("pitch"), F.col("mask"), F.col("average")))


def _overlaps(stuck_notes: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of a stuck note and another note of the song that sound together (strictly), by time blocks."""
    cells = lambda: F.explode(F.sequence(F.floor(F.col("onset_us") / PAIR_BLOCK_US).cast("bigint"), F.floor(F.greatest("onset_us", F.col("offset_us") - 1) / PAIR_BLOCK_US).cast("bigint")))
    a = stuck_notes.select("song", cells().alias("_cell"), "note_id", F.col("pos").alias("a_pos"), "onset_us", "offset_us", "target")
    b = others.select("song", cells().alias("_cell"), F.col("note_id").alias("other_id"), F.col("pos").alias("b_pos"), F.col("onset_us").alias("b_on"), F.col("offset_us").alias("b_off"), F.col("pitch").alias("b_pitch"), F.col("b_target"))
    pairs = a.join(b, ["song", "_cell"]).where((F.col("note_id") != F.col("other_id")) & (F.col("b_on") < F.col("offset_us")) & (F.col("onset_us") < F.col("b_off")))
    return pairs.where((F.col("b_pitch") == F.col("target")) | (F.col("b_target") == F.col("target"))).dropDuplicates(["note_id", "other_id"])


def corrected(tagged: DataFrame) -> DataFrame:
    """Every stuck note with ``moved``: whether the pass in note order corrects it.

    A note is skipped if its target would collide with a note that sounds with it:
    earlier notes at the pitch the pass has given them, later ones at their own. The
    order only matters along chains of colliding stuck notes, so the pass is the fixed
    point of a join that settles every chain from its first note on; each round
    settles at least one more link, and no song is ever walked note by note.
    """
    marked = cut(stuck(tagged).select("song", "note_id", "pos", "onset_us", "offset_us", "seg_start_us", "seg_end_us", "mask", "pitch", "average", "target"))
    placed = with_context(tagged.select("song", "note_id", "onset_us", "offset_us", "pitch"), "song", "onset_us", "note_id", F.lit(1))
    others = placed.join(marked.select("note_id", F.col("target").alias("b_target")), "note_id", "left")
    pairs = cut(_overlaps(marked, others))
    earlier = F.col("b_pos") < F.col("a_pos")
    fixed = pairs.where((F.col("b_pitch") == F.col("target")) & (~earlier | F.col("b_target").isNull())).select("note_id").distinct()
    chains = pairs.where(earlier & F.col("b_target").isNotNull()).select("note_id", "other_id", "target", "b_pitch", "b_target")
    base = cut(marked.select("note_id").join(fixed.withColumn("blocked", F.lit(True)), "note_id", "left").select("note_id", F.coalesce("blocked", F.lit(False)).alias("blocked")))
    state = base.withColumn("moved", ~F.col("blocked"))
    while True:
        now = chains.join(state.select(F.col("note_id").alias("other_id"), F.col("moved").alias("b_moved")), "other_id")
        hit = now.where(F.when(F.col("b_moved"), F.col("b_target")).otherwise(F.col("b_pitch")) == F.col("target")).select("note_id").distinct().withColumn("hit", F.lit(True))
        after = cut(base.join(hit, "note_id", "left").select("note_id", "blocked", (~F.col("blocked") & F.col("hit").isNull()).alias("moved")))
        changed = after.join(state.select("note_id", F.col("moved").alias("was")), "note_id").where("moved <> was").limit(1).count()
        state = after
        if not changed:
            break
    return marked.join(state.select("note_id", "moved"), "note_id")


def zip_by_rank(a: DataFrame, b: DataFrame, group: str, at: str, tie: str) -> DataFrame:
    """Two tables paired by place in the group; the side without a partner is NULL."""
    left = with_context(a, group, at, tie, F.lit(1))
    right = with_context(b, group, at, tie, F.lit(1))
    return left.alias("a").join(right.alias("b"), [group, "pos"], "full")


def last_entries(log: DataFrame) -> DataFrame:
    """The changelog (song, onset_us, corrected_pitch, original_pitch, place) as a dictionary: of entries with one onset and corrected pitch the last wins."""
    return log.groupBy("song", "onset_us", "corrected_pitch").agg(F.max_by("original_pitch", "place").alias("original_pitch"))


def reconcile(merged: DataFrame, corrected_notes: DataFrame, log: DataFrame, tolerance_us: int = 100) -> DataFrame:
    """song, place, note_id, problem: merged notes, corrected notes and the changelog against each other.

    merged is (song, id, onset_us, pitch, mask), corrected_notes (song, id, onset_us,
    pitch), log (song, onset_us, original_pitch, corrected_pitch). Notes are paired by
    place in their song; a note's log entry is the first by time within the tolerance
    with its original pitch. A record may have several problems.
    """
    pairs = zip_by_rank(merged, corrected_notes, "song", "onset_us", "id")
    pairs = pairs.select("song", "pos", F.col("a.id").alias("note_id"), F.col("a.onset_us").alias("t"), F.col("a.pitch").alias("before"), F.col("a.mask").alias("mask"), F.col("b.onset_us").alias("t_after"), F.col("b.pitch").alias("after"))
    cell = lambda c: F.floor(c / (2 * tolerance_us + 1)).cast("bigint")
    near = F.array_distinct(F.array(cell(F.col("onset_us") - tolerance_us), cell(F.col("onset_us") + tolerance_us)))
    entries = log.select("song", F.col("original_pitch").alias("before"), F.col("onset_us").alias("l_t"), "corrected_pitch", F.explode(near).alias("cell"))
    hits = pairs.select("song", "pos", "t", "before", cell(F.col("t")).alias("cell")).join(entries, ["song", "before", "cell"]).where(F.abs(F.col("l_t") - F.col("t")) <= tolerance_us)
    first = hits.groupBy("song", "pos").agg(F.min(F.struct("l_t", "corrected_pitch")).alias("entry"))
    df = pairs.join(first, ["song", "pos"], "left")
    changed, logged = F.col("after") != F.col("before"), F.col("entry").isNotNull()
    inside = F.call_function("shiftright", F.col("mask"), F.pmod("after", F.lit(12)).cast("int")).bitwiseAND(F.lit(1)) == 1
    rules = {
        "no partner": F.col("before").isNull() | F.col("after").isNull() | (F.abs(F.col("t") - F.col("t_after")) > tolerance_us),
        "changed without an entry": changed & ~logged,
        "entry with another pitch": changed & (F.col("entry.corrected_pitch") != F.col("after")),
        "corrected outside the chord": changed & ~inside,
        "entry without a change": ~changed & logged,
    }
    problems = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return df.select("song", F.col("pos").alias("place"), "note_id", F.explode(problems).alias("problem"))


def song_status(eligible: DataFrame, processed: DataFrame, failed: DataFrame) -> DataFrame:
    """song, status: every eligible song as ok, failed (in the failure log and not processed since) or not_processed."""
    done = processed.select("song").distinct().withColumn("done", F.lit(True))
    lost = failed.select("song").distinct().withColumn("lost", F.lit(True))
    df = eligible.select("song").distinct().join(done, "song", "left").join(lost, "song", "left")
    return df.select("song", F.when(F.col("done"), "ok").when(F.col("lost"), "failed").otherwise("not_processed").alias("status"))
