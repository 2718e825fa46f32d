"""Sequences: intervals, n-grams, entropy, gaps and the calibration constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.functions.chords import CHORD_CLASSES, ZERO_MASKS, jaccard
from cantus.operators.ordered import with_context
from cantus.plans.registry import query
from cantus.plans.storage import cut, table
from cantus.sources import music

INTERVAL_SQL = "step AS (SELECT song, note_id, onset_us, pitch, row_number() OVER w - 1 AS note_index, pitch - lag(pitch) OVER w AS interval, onset_us - lag(onset_us) OVER w AS gap_us FROM note WINDOW w AS (PARTITION BY song ORDER BY onset_us, note_id))"


def intervals(spark: SparkSession, d: str) -> DataFrame:
    df = with_context(music.notes(spark, d), "song", "onset_us", "note_id", F.struct("pitch", "onset_us"), before=1)
    before = F.get("prev", F.lit(0))
    return df.select("song", "note_id", "onset_us", "pitch", F.col("pos").alias("note_index"), (F.col("pitch") - before.pitch).alias("interval"), (F.col("onset_us") - before.onset_us).alias("gap_us"))


@query("SELECT song, note_index, onset_us, pitch, interval FROM step", ("note",), (INTERVAL_SQL,))
def note_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Note sequences with the melodic interval from the note before, NULL on the first."""
    return intervals(spark, d).select("song", "note_index", "onset_us", "pitch", "interval")


ENTROPY_SQL = "entropy AS (SELECT song, sum(n) AS n, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM (SELECT song, interval, count(*) AS n, sum(count(*)) OVER (PARTITION BY song) AS total FROM step WHERE interval IS NOT NULL GROUP BY song, interval) GROUP BY song)"


def entropies(spark: SparkSession, d: str) -> DataFrame:
    """Shannon entropy of each song's intervals, in bits."""
    counts = intervals(spark, d).where("interval is not null").groupBy("song", "interval").agg(F.count("*").alias("n"))
    sums = counts.groupBy("song").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select("song", "n", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


@query("SELECT song, CAST(n AS BIGINT) AS n, abs(round(entropy, 4)) AS entropy FROM entropy", ("note",), (INTERVAL_SQL, ENTROPY_SQL))
def interval_entropy(spark: SparkSession, d: str) -> DataFrame:
    return entropies(spark, d).select("song", "n", F.abs(F.round("entropy", 4)).alias("entropy"))


@query("""SELECT 2 AS n, ngram, CAST(sum(c) AS BIGINT) AS total_occurrences, count(*) AS song_count, min_by(song, struct_pack(a := -c, b := song)) AS example_song, max(c) AS example_song_count FROM (SELECT song, a || '|' || b AS ngram, count(*) AS c FROM sym WHERE b IS NOT NULL GROUP BY song, ngram) GROUP BY ngram
UNION ALL SELECT 3 AS n, ngram, CAST(sum(c) AS BIGINT), count(*), min_by(song, struct_pack(a := -c, b := song)), max(c) FROM (SELECT song, a || '|' || b || '|' || c3 AS ngram, count(*) AS c FROM sym WHERE b IS NOT NULL AND c3 IS NOT NULL GROUP BY song, ngram) GROUP BY ngram""",
    ("seg",), ("sym AS (SELECT song, cls AS a, lead(cls, 1) OVER w AS b, lead(cls, 2) OVER w AS c3 FROM seg WHERE cls IS NOT NULL WINDOW w AS (PARTITION BY song ORDER BY start_us, idx))",))
def chord_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Class n-grams of two and three with their totals and the song that has most of them (ties: the smallest name)."""
    df = with_context(music.segments(spark, d).where("cls is not null"), "song", "start_us", "idx", F.col("cls"), after=2)
    grams = F.filter(F.array(*(F.when(F.size("next") >= n - 1, F.struct(F.lit(n).alias("n"), F.array_join(F.concat(F.array("cls"), F.slice("next", 1, n - 1)), "|").alias("ngram"))) for n in (2, 3))), lambda x: x.isNotNull())
    per_song = df.select("song", F.explode(grams).alias("g")).groupBy("song", "g.n", "g.ngram").agg(F.count("*").alias("c"))
    return per_song.groupBy("n", "ngram").agg(F.sum("c").alias("total_occurrences"), F.count("*").alias("song_count"), F.min(F.struct((-F.col("c")).alias("c"), "song")).alias("x")).select("n", "ngram", "total_occurrences", "song_count", F.col("x.song").alias("example_song"), (-F.col("x.c")).alias("example_song_count"))


NGRAM_SQL = """
sym AS (SELECT song, cls AS a, lead(cls, 1) OVER w AS b, lead(cls, 2) OVER w AS c3 FROM seg WHERE cls IS NOT NULL WINDOW w AS (PARTITION BY song ORDER BY start_us, idx)),
gram AS (SELECT song, 2 AS n, a || '|' || b AS ngram FROM sym WHERE b IS NOT NULL UNION ALL SELECT song, 3, a || '|' || b || '|' || c3 FROM sym WHERE c3 IS NOT NULL)"""


@query("SELECT n, ngram, count(DISTINCT song) AS song_count, count(*) AS total_occurrences FROM gram GROUP BY n, ngram ORDER BY song_count DESC, total_occurrences DESC, n, ngram LIMIT 15", ("seg",), (NGRAM_SQL,))
def top_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen n-grams of most songs (the report's length is its feature)."""
    return chord_ngrams(spark, d).orderBy(F.desc("song_count"), F.desc("total_occurrences"), "n", "ngram").limit(15).select("n", "ngram", "song_count", "total_occurrences")


@query("SELECT round(sum(n * n) / pow(sum(n), 2), 6) AS root_equal FROM (SELECT root, count(*)::DOUBLE AS n FROM seg WHERE root IS NOT NULL GROUP BY root)", ("seg",))
def corpus_root_equal(spark: SparkSession, d: str) -> DataFrame:
    """Probability that two chords drawn by their frequency have one root (twelve counts)."""
    n = music.segments(spark, d).where("root is not null").groupBy("root").agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.round(F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2.0)), 6).alias("root_equal"))


@query("SELECT CASE WHEN gap_us < 10000 THEN 'below 0.01' WHEN gap_us < 50000 THEN 'below 0.05' WHEN gap_us <= 200000 THEN '0.05 to 0.2' ELSE 'above 0.2' END AS bucket, count(*) AS n FROM step WHERE gap_us IS NOT NULL GROUP BY bucket", ("note",), (INTERVAL_SQL,))
def gap_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Onset gaps to the note before, in four buckets."""
    bucket = F.when(F.col("gap_us") < 10000, "below 0.01").when(F.col("gap_us") < 50000, "below 0.05").when(F.col("gap_us") <= 200000, "0.05 to 0.2").otherwise("above 0.2")
    return intervals(spark, d).where("gap_us is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS transitions, count(*) FILTER (mask = before) AS repeats, round(count(*) FILTER (mask = before) / count(*), 6) AS share FROM (SELECT mask, lag(mask) OVER (PARTITION BY song ORDER BY start_us, idx) AS before FROM seg WHERE mask IS NOT NULL) WHERE before IS NOT NULL", ("seg",))
def repeat_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of transitions that repeat the chord."""
    df = with_context(music.segments(spark, d).where("mask is not null"), "song", "start_us", "idx", F.col("mask"), before=1).where(F.size("prev") > 0)
    return df.agg(F.count("*").alias("transitions"), F.count_if(F.get("prev", F.lit(0)) == F.col("mask")).alias("repeats")).withColumn("share", F.round(F.col("repeats") / F.col("transitions"), 6))


@query("SELECT quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, avg(x)::DOUBLE AS mean FROM (SELECT CAST(end_us - start_us AS DOUBLE) AS x FROM seg)", ("seg",))
def duration_quantiles(spark: SparkSession, d: str) -> DataFrame:
    df = music.segments(spark, d).select((F.col("end_us") - F.col("start_us")).cast("double").alias("x"))
    q = F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return df.agg(q.alias("q"), F.sum("x").alias("s"), F.count("x").alias("n")).select(F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p90"), (F.col("s") / F.col("n")).alias("mean"))


FEW, PARTS = 10_000, 1_000


def kth_smallest(values: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th smallest value (from 1), by counting: the interval that holds it is cut into PARTS until it has at most FEW different values, which are counted one by one. Nothing is sorted in one task."""
    x = F.col(column).cast("double")
    df = values.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    while True:
        lo, hi = df.agg(F.min("x"), F.max("x")).first()
        if lo is None:
            return None
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("x") - lo) / max(hi - lo, 1e-300) * PARTS)).cast("int")
        few = df.groupBy("x").agg(F.count("*").alias("n")).limit(FEW + 1).collect()  # at most FEW + 1 rows
        if len(few) <= FEW:
            for r in sorted(few):
                k -= r.n
                if k <= 0:
                    return r.x
            return hi
        counts = sorted(df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # at most PARTS rows
        for r in counts:
            if k <= r.n:
                df = df.where(part == r.part)
                break
            k -= r.n
        else:
            return hi


def quartile_exclusive(values: DataFrame, column: str) -> DataFrame:
    """Lower quartile by the exclusive method (one row)."""
    n = values.where(F.col(column).isNotNull()).count()
    at = min(max((n + 1) / 4, 1.0), float(max(n, 1)))
    a, b = kth_smallest(values, column, int(at)), kth_smallest(values, column, min(int(at) + 1, max(n, 1)))
    return values.sparkSession.createDataFrame([(None if a is None else a + (b - a) * (at - int(at)),)], "p25 double")


@query("""SELECT round(a + (b - a) * (pos - floor(pos)), 6) AS p25 FROM (SELECT list_extract(l, CAST(greatest(1, floor((len(l) + 1) / 4)) AS BIGINT)) AS a, list_extract(l, CAST(least(len(l), floor((len(l) + 1) / 4) + 1) AS BIGINT)) AS b, (len(l) + 1) / 4 AS pos FROM (SELECT list(entropy ORDER BY entropy) AS l FROM entropy))""", ("note",), (INTERVAL_SQL, ENTROPY_SQL))
def entropy_quartile(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive lower quartile of the songs' entropies: below it a song is of low complexity."""
    return quartile_exclusive(cut(entropies(spark, d)), "entropy").select(F.round("p25", 6).alias("p25"))


@query("""SELECT round(sum(a.n * b.n * (bit_count(za.m & zb.m) / bit_count(za.m | zb.m))) / sum(a.n * b.n), 6) AS mean_jaccard FROM freq a, freq b, zm za, zm zb WHERE za.cls = a.cls AND zb.cls = b.cls""", ("seg",),
    ("freq AS (SELECT cls, count(*) AS n FROM seg WHERE cls IS NOT NULL GROUP BY cls)", "zm AS (SELECT cls, mask AS m FROM rolled WHERE root = 0)"))
def corpus_mean_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Mean set similarity of two classes drawn by their frequency (nine rows a side)."""
    freq = music.segments(spark, d).where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"))
    zero = spark.createDataFrame([(c, m) for (c, _, _), m in zip(CHORD_CLASSES, ZERO_MASKS)], "cls string, m int")
    side = lambda s: freq.join(F.broadcast(zero), "cls").select(F.col("n").alias(f"n{s}"), F.col("m").alias(f"m{s}"))
    w = F.col("na") * F.col("nb")
    return side("a").crossJoin(F.broadcast(side("b"))).agg(F.round(F.sum(w * jaccard(F.col("ma"), F.col("mb"))) / F.sum(w), 6).alias("mean_jaccard"))


@query("SELECT round(sum(a.n * b.n * greatest(0, 1 - abs(a.interval - b.interval) / 6)) / sum(a.n * b.n), 6) AS mean_similarity FROM f a, f b", ("note",), (INTERVAL_SQL, "f AS (SELECT interval, CAST(count(*) AS DOUBLE) AS n FROM step WHERE interval IS NOT NULL GROUP BY interval)"))
def corpus_mean_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Mean interval similarity of two intervals drawn by their frequency (at most 255 values a side)."""
    freq = intervals(spark, d).where("interval is not null").groupBy("interval").agg(F.count("*").cast("double").alias("n"))
    other = freq.select(F.col("interval").alias("j"), F.col("n").alias("m"))
    w = F.col("n") * F.col("m")
    return freq.crossJoin(F.broadcast(other)).agg(F.round(F.sum(w * F.greatest(F.lit(0.0), 1 - F.abs(F.col("interval") - F.col("j")) / 6)) / F.sum(w), 6).alias("mean_similarity"))


@query("SELECT artist, count(DISTINCT track_id) AS songs FROM (SELECT track_id, unnest(artists_all) AS artist FROM k_indie_songs) GROUP BY artist ORDER BY songs DESC, artist LIMIT 10")
def artist_counts(spark: SparkSession, d: str) -> DataFrame:
    """The ten artists with most songs (the report's length is its feature)."""
    df = table(spark, d, "k_indie_songs").select("track_id", F.explode("artists_all").alias("artist")).distinct()
    return df.groupBy("artist").agg(F.count("*").alias("songs")).orderBy(F.desc("songs"), "artist").limit(10)
