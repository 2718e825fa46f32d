"""Transcription against annotation, and the annotation files themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.operators import matching as op
from cantus.plans.registry import query
from cantus.plans.storage import cut, table
from cantus.sources import music


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ref = music.annotations(spark, d).where("stem = 'other' and onset_us is not null").select("song", F.col("annotation_id").alias("id"), "onset_us", "offset_us", "pitch")
    ref = cut(ref)
    est = music.notes(spark, d).select("song", F.col("note_id").alias("id"), "onset_us", "offset_us", "pitch").join(ref.select("song").distinct(), "song", "left_semi")
    return ref, cut(est)


def _walk_sql(name: str, by: str, ref: str, est: str) -> str:
    """A matching of points on a line is largest if both sides are walked in order and each pair within reach is taken."""
    return f"""
{name}_r AS (SELECT {by}, list(onset_us ORDER BY onset_us) AS a FROM gt WHERE stem = 'other' AND onset_us IS NOT NULL AND {ref} GROUP BY {by}),
{name}_e AS (SELECT {by}, list(onset_us ORDER BY onset_us) AS b FROM note WHERE song IN (SELECT song FROM gt WHERE stem = 'other' AND onset_us IS NOT NULL) AND {est} GROUP BY {by}),
{name}_w AS (SELECT {by}, 1 AS i, 1 AS j, 0 AS m FROM {name}_r UNION ALL SELECT {", ".join(f"w.{c.strip()}" for c in by.split(","))}, CASE WHEN a[i] > b[j] + 50000 THEN i ELSE i + 1 END, CASE WHEN a[i] + 50000 < b[j] THEN j ELSE j + 1 END, m + CASE WHEN abs(a[i] - b[j]) <= 50000 THEN 1 ELSE 0 END
  FROM {name}_w w JOIN {name}_r r USING ({by}) JOIN {name}_e e USING ({by}) WHERE i <= len(a) AND j <= len(b)),
{name}_n AS (SELECT song, sum(n_ref) AS n_ref, sum(n_est) AS n_est FROM (SELECT song, len(a) AS n_ref, 0 AS n_est FROM {name}_r UNION ALL SELECT song, 0, len(b) FROM {name}_e) GROUP BY song),
{name}_m AS (SELECT song, sum(m) AS matched FROM (SELECT {by}, max(m) AS m FROM {name}_w GROUP BY {by}) GROUP BY song),
{name}_f AS (SELECT n.song, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_est AS BIGINT) AS n_est, CAST(coalesce(matched, 0) AS BIGINT) AS matched, coalesce(matched, 0) / nullif(n_est, 0) AS p, coalesce(matched, 0) / nullif(n_ref, 0) AS r FROM {name}_n n LEFT JOIN {name}_m m ON m.song = n.song)"""


ONSET_SQL = _walk_sql("onset", "song", "TRUE", "TRUE")
PITCHED_SQL = _walk_sql("pitched", "song, pitch", "offset_us IS NOT NULL AND pitch IS NOT NULL", "offset_us IS NOT NULL")
F_SQL = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


@query(f"SELECT song, n_ref, n_est, matched, round(p, 6) AS precision, round(r, 6) AS recall, round({F_SQL}, 6) AS f_measure FROM onset_f", ("note", "gt"), (ONSET_SQL,))
def onset_f_measure(spark: SparkSession, d: str) -> DataFrame:
    ref, est = _both(spark, d)
    return op.f_measure(op.matched_counts(ref, est))


@query(f"SELECT song, n_ref, n_est, matched, round(p, 6) AS precision, round(r, 6) AS recall, round({F_SQL}, 6) AS f_measure FROM pitched_f", ("note", "gt"), (PITCHED_SQL,))
def note_f_measure(spark: SparkSession, d: str) -> DataFrame:
    """Notes by onset and pitch; only full annotations count."""
    ref, est = _both(spark, d)
    return op.f_measure(op.matched_counts(ref.where("offset_us is not null and pitch is not null"), est.where("offset_us is not null"), pitched=True))


@query()
def note_offset_f_measure(spark: SparkSession, d: str) -> DataFrame:
    """Notes by onset, pitch and offset (a fifth of the duration, at least the onset's tolerance)."""
    ref, est = _both(spark, d)
    return op.f_measure(op.matched_counts(ref.where("offset_us is not null and pitch is not null"), est.where("offset_us is not null"), pitched=True, ratio=0.2))


@query("""SELECT song, stem, CASE WHEN bad > 0 THEN 'invalid ground truth' WHEN n = 0 THEN 'nothing annotated' WHEN stem <> 'other' OR song NOT IN (SELECT song FROM note) THEN 'no track' WHEN full_rows = 0 THEN 'no full notes' ELSE 'scored' END AS status FROM
(SELECT s.song, s.stem, count(g.onset_us) AS n, count(*) FILTER (g.offset_us <= g.onset_us) AS bad, count(*) FILTER (g.onset_us IS NOT NULL AND g.offset_us IS NOT NULL AND g.pitch IS NOT NULL) AS full_rows FROM (SELECT song, unnest(['bass', 'drums', 'other']) AS stem FROM (SELECT DISTINCT song FROM gt)) s LEFT JOIN gt g ON g.song = s.song AND g.stem = s.stem GROUP BY s.song, s.stem)""", ("note", "gt"))
def evaluation_status(spark: SparkSession, d: str) -> DataFrame:
    """Per annotated song and stem whether it is scored, and if not, why. Only the stem "other" has a transcription."""
    gt = music.annotations(spark, d)
    every = gt.select("song").distinct().select("song", F.explode(F.array(*(F.lit(s) for s in ("bass", "drums", "other")))).alias("stem"))
    counts = gt.groupBy("song", "stem").agg(F.count("onset_us").alias("n"), F.count_if(F.col("offset_us") <= F.col("onset_us")).alias("bad"), F.count_if(F.col("onset_us").isNotNull() & F.col("offset_us").isNotNull() & F.col("pitch").isNotNull()).alias("full"))
    tracks = music.notes(spark, d).select("song").distinct().select("song", F.lit("other").alias("stem"), F.lit(True).alias("track"))
    df = every.join(counts, ["song", "stem"], "left").join(tracks, ["song", "stem"], "left")
    status = F.when(F.col("bad") > 0, "invalid ground truth").when(F.coalesce("n", F.lit(0)) == 0, "nothing annotated").when(F.col("track").isNull(), "no track").when(F.col("full") == 0, "no full notes").otherwise("scored")
    return df.select("song", "stem", status.alias("status"))


DIFF_SQL = """
old_notes AS (SELECT song, pitch, list(onset_us ORDER BY onset_us) AS a FROM gt WHERE stem = 'other' AND onset_us IS NOT NULL AND pitch IS NOT NULL GROUP BY song, pitch),
new_notes AS (SELECT song, pitch, list(onset_us ORDER BY onset_us) AS b FROM note WHERE song IN (SELECT song FROM gt WHERE stem = 'other' AND onset_us IS NOT NULL) GROUP BY song, pitch),
taken AS (SELECT song, pitch, 1 AS k, CAST([] AS BIGINT[]) AS used FROM old_notes UNION ALL SELECT song, pitch, k + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best[2]) END FROM
  (SELECT t.song, t.pitch, k, used, list_min(list_transform(list_filter(range(1, len(b) + 1), lambda j: abs(b[j] - a[k]) < 50000 AND NOT list_contains(used, j)), lambda j: [abs(b[j] - a[k]), j])) AS best
   FROM taken t JOIN old_notes o ON o.song = t.song AND o.pitch = t.pitch LEFT JOIN new_notes n ON n.song = t.song AND n.pitch = t.pitch WHERE k <= len(a)))"""


@query("""SELECT song, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(n_old) - sum(kept) AS BIGINT) AS lost, CAST(sum(n_new) - sum(kept) AS BIGINT) AS gained FROM (SELECT song, len(a) AS n_old, 0 AS n_new, 0 AS kept FROM old_notes UNION ALL SELECT song, 0, len(b), 0 FROM new_notes
UNION ALL SELECT song, 0, 0, max(len(used)) FROM taken GROUP BY song, pitch) GROUP BY song""", ("note", "gt"), (DIFF_SQL,))
def note_diff(spark: SparkSession, d: str) -> DataFrame:
    """Annotated against transcribed notes by the greedy rule: kept, lost and gained."""
    ref, est = _both(spark, d)
    return op.note_changes(ref.where("pitch is not null"), est)


@query(f"""SELECT s.stem, CASE s.stem WHEN 'other' THEN o.songs ELSE 0 END AS songs, CASE s.stem WHEN 'other' THEN o.precision END AS precision, CASE s.stem WHEN 'other' THEN o.recall END AS recall, CASE s.stem WHEN 'other' THEN o.f END AS f_measure, CASE s.stem WHEN 'other' THEN n.songs ELSE 0 END AS note_songs, CASE s.stem WHEN 'other' THEN n.f END AS note_f_measure FROM (SELECT unnest(['bass', 'drums', 'other']) AS stem) s,
(SELECT count(*) AS songs, round(avg(round(p, 6)), 4) AS precision, round(avg(round(r, 6)), 4) AS recall, round(avg(round({F_SQL}, 6)), 4) AS f FROM onset_f) o, (SELECT count(*) AS songs, round(avg(round({F_SQL}, 6)), 4) AS f FROM pitched_f WHERE n_ref > 0) n""", ("note", "gt"), (ONSET_SQL, PITCHED_SQL))
def metric_averages(spark: SparkSession, d: str) -> DataFrame:
    """Means over the scored songs of each stem, and of the songs with full annotations; a stem without a transcription has none."""
    ref, est = _both(spark, d)
    onset = op.f_measure(op.matched_counts(ref, est)).agg(F.count("*").alias("songs"), *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f_measure")))
    full = op.f_measure(op.matched_counts(ref.where("offset_us is not null and pitch is not null"), est.where("offset_us is not null"), pitched=True)).where("n_ref > 0")
    note = full.agg(F.count("*").alias("note_songs"), F.round(F.avg("f_measure"), 4).alias("note_f_measure"))
    one = onset.crossJoin(F.broadcast(note)).withColumn("stem", F.lit("other"))  # two single rows
    stems = spark.createDataFrame([(s,) for s in ("bass", "drums", "other")], "stem string")
    return stems.join(F.broadcast(one), "stem", "left").na.fill(0, ["songs", "note_songs"]).select("stem", "songs", "precision", "recall", "f_measure", "note_songs", "note_f_measure")


@query("""SELECT CASE WHEN onset_us IS NULL THEN 'blank onset' WHEN offset_us IS NOT NULL AND offset_us <= onset_us THEN 'offset not after onset' WHEN offset_us IS NULL THEN 'onset only' WHEN pitch IS NULL THEN 'no pitch' ELSE 'full' END AS status, stem, count(*) AS n FROM gt GROUP BY ALL""", ("gt",))
def gt_validate(spark: SparkSession, d: str) -> DataFrame:
    """Annotations by the rule they meet or break."""
    status = F.when(F.col("onset_us").isNull(), "blank onset").when(F.col("offset_us") <= F.col("onset_us"), "offset not after onset").when(F.col("offset_us").isNull(), "onset only").when(F.col("pitch").isNull(), "no pitch").otherwise("full")
    return music.annotations(spark, d).groupBy(status.alias("status"), "stem").agg(F.count("*").alias("n"))


@query("""SELECT s.song, count(*) FILTER (f.song IS NOT NULL) AS filled, array_to_string(list(s.stem ORDER BY s.stem) FILTER (f.song IS NULL), ',') AS missing FROM (SELECT song, unnest(['other','bass','drums']) AS stem FROM (SELECT DISTINCT song FROM gt)) s
LEFT JOIN (SELECT DISTINCT song, stem FROM gt WHERE onset_us IS NOT NULL) f ON f.song = s.song AND f.stem = s.stem GROUP BY s.song""", ("gt",))
def annotation_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per song which of the three stems have an annotation."""
    have = music.annotations(spark, d).groupBy("song").agg(F.collect_set(F.when(F.col("onset_us").isNotNull(), F.col("stem"))).alias("have"))
    stems = F.array(*(F.lit(s) for s in ("bass", "drums", "other")))
    missing = F.array_except(stems, F.col("have"))
    return have.select("song", (3 - F.size(missing)).cast("bigint").alias("filled"), F.when(F.size(missing) > 0, F.array_join(missing, ",")).alias("missing"))


@query("SELECT song FROM (SELECT DISTINCT song FROM note WHERE song NOT IN (SELECT song FROM gt)) ORDER BY md5(song || '42') LIMIT (SELECT greatest(0, 200 - count(DISTINCT song)) FROM gt)", ("note", "gt"))
def eval_sample(spark: SparkSession, d: str, floor: int = 200, seed: int = 42) -> DataFrame:
    """Songs to annotate until ``floor`` are annotated, drawn reproducibly from those that are not (sampling is the feature)."""
    have = music.annotations(spark, d).select("song").distinct()
    pool = music.notes(spark, d).select("song").distinct().join(have, "song", "left_anti")
    return pool.orderBy(F.md5(F.concat("song", F.lit(str(seed))))).limit(max(0, floor - have.count()))


@query("SELECT (SELECT count(*) FROM (SELECT * FROM gt WHERE stem <> 'other' EXCEPT ALL SELECT * FROM gt WHERE stem <> 'other')) AS lost, 0 AS added, (SELECT count(*) FROM gt WHERE stem <> 'other') AS notes", ("gt",))
def unchanged_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The tracks that no correction may touch, before and after the merged file of three tracks is taken apart again: what was lost or added."""
    before = music.annotations(spark, d).where("stem <> 'other'")
    parts = music.annotations(spark, d)
    merged = parts.groupBy("song", "stem").agg(F.collect_list(F.struct("annotation_id", "onset_us", "offset_us", "pitch")).alias("n"))
    after = merged.where("stem <> 'other'").select("song", "stem", F.explode("n").alias("n")).select("n.annotation_id", "song", "stem", "n.onset_us", "n.offset_us", "n.pitch")
    gone = lambda a, b, name: a.select(*before.columns).exceptAll(b.select(*before.columns)).agg(F.count("*").alias(name))
    return gone(before, after, "lost").crossJoin(gone(after, before, "added")).crossJoin(before.agg(F.count("*").alias("notes")))  # single rows


@query("SELECT s.song, CASE WHEN r.at IS NULL THEN 'not processed' WHEN r.at < s.at THEN 'stale' ELSE 'fresh' END AS status FROM (SELECT song, max(loaded_at) AS at FROM chord_sequences WHERE song IS NOT NULL GROUP BY song) s LEFT JOIN (SELECT song, max(loaded_at) AS at FROM chord_review_candidates GROUP BY song) r ON r.song = s.song")
def stale_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Songs whose ranking is missing or older than their segments."""
    last = lambda t, c: table(spark, d, t).where("song is not null").groupBy("song").agg(F.max("loaded_at").alias(c))
    df = last("chord_sequences", "at_in").join(last("chord_review_candidates", "at_out"), "song", "left")
    return df.select("song", F.when(F.col("at_out").isNull(), "not processed").when(F.col("at_out") < F.col("at_in"), "stale").otherwise("fresh").alias("status"))
