"""Queries of the training-data problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.llm import cuts, leaks, linkage, nearest, patterns, runs, segments, tokens, topn
from cantus.plans.storage import table


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.identified(table(spark, d, "chord_sequences"), table(spark, d, "chord_classes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.found(runs.chord_runs(_segments(spark, d)))


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single segments included, as one event with its number of segments and its times."""
    r = runs.chord_runs(_segments(spark, d))
    return r.select("song", "first_index", "last_index", "class_name", "n_segments", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), F.round(F.col("sounding_sec") * 1e6).cast("bigint").alias("sounding_us"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return patterns.frequent_patterns(_segments(spark, d)).select("pattern")


def p2_support(spark: SparkSession, d: str) -> DataFrame:
    return patterns.frequent_patterns(_segments(spark, d)).select("pattern", "support", "songs")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.review_first(table(spark, d, "chord_review_candidates")).select("song", "place", "segment_index")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.annotations_to_notes(table(spark, d, "gt_annotations"), table(spark, d, "other_note_tags")).select("annotation_id", "note_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.same_recordings(table(spark, d, "k_indie_songs"), table(spark, d, "liked_songs")).select("track_id", "liked_id")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.same_recordings(table(spark, d, "k_indie_songs"), table(spark, d, "liked_songs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids do not give the text again: none."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").groupBy().agg(F.count("*").alias("documents"), F.count_if(F.col("text") != F.col("decoded")).alias("changed"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with the length of its passage and the words that match whole."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return cuts.found(table(spark, d, "documents"))


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    return cuts.by_source(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_events, p2_found, p2_support, p3_found, p4_found, p5_found, p5_confidence, p6_ids, p6_round_trip, p7_found, p7_leaks, p8_found, p8_by_source)}

# One row per segment: start, set (as the sorted text of its pitch classes) and class.
_SEGMENTS = """
numbered AS (SELECT c.forte_class AS cls, list_sort(list_transform(string_split(c.root_zero_set, ','), lambda x: CAST(x AS INT))) AS zero FROM chord_classes c),
rolled AS (SELECT cls, r.root, list_sort(list_transform(zero, lambda x: (x + r.root) % 12)) AS pcs, zero FROM numbered, (SELECT unnest(range(12)) AS root) r),
raw AS (SELECT song, segment_index, start_sec, end_sec, duration, loaded_at,
   list_sort(list_distinct(list_transform(regexp_extract_all(pitch_class_set, '[0-9]+'), lambda x: CAST(x AS INT) % 12))) AS own, root_pc,
   regexp_replace(upper(forte_class), '[^0-9A-Z]', '', 'g') AS spelled FROM chord_sequences),
named AS (SELECT raw.*, n.cls AS named_cls, n.zero FROM raw LEFT JOIN numbered n ON raw.spelled = replace(n.cls, '-', '')),
keyed AS (SELECT *, CASE WHEN own IS NOT NULL AND len(own) > 0 THEN own ELSE list_sort(list_transform(zero, lambda x: (x + root_pc) % 12)) END AS pcs FROM named),
owned AS (SELECT k.*, coalesce(k.named_cls, (SELECT min(rolled.cls) FROM rolled WHERE rolled.pcs = k.pcs)) AS cls FROM keyed k),
seg AS (SELECT song, segment_index, any_value(start_sec) AS start_sec, any_value(end_sec) AS end_sec, any_value(duration) AS duration,
   max(array_to_string(pcs, ',')) AS pcs, max(cls) AS cls FROM owned WHERE song IS NOT NULL AND segment_index IS NOT NULL GROUP BY song, segment_index)
"""
_RUNS = f"""
WITH {_SEGMENTS},
flagged AS (SELECT *, CASE WHEN pcs = lag(pcs) OVER w THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY song ORDER BY start_sec, segment_index)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY song ORDER BY start_sec, segment_index ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
"""
_PATTERNS = f"""
WITH {_SEGMENTS},
placed AS (SELECT song, cls, row_number() OVER (PARTITION BY song ORDER BY start_sec, segment_index) AS pos FROM seg),
steps AS (SELECT * FROM placed WHERE cls IS NOT NULL),
supports AS (SELECT a.cls || '>' || b.cls || '>' || c.cls || '>' || d.cls AS pattern, count(DISTINCT a.song) AS support
   FROM steps a JOIN steps b ON b.song = a.song AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 JOIN steps c ON c.song = b.song AND c.pos BETWEEN b.pos + 1 AND b.pos + 3
   JOIN steps d ON d.song = c.song AND d.pos BETWEEN c.pos + 1 AND c.pos + 3 GROUP BY 1),
songs AS (SELECT count(DISTINCT song) AS songs FROM seg)
"""

ORACLE: dict[str, str] = {
    "p6_round_trip": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS changed FROM documents",
    "p1_found": _RUNS + "SELECT song, CAST(arg_min(segment_index, start_sec) AS BIGINT) AS first_index, CAST(arg_max(segment_index, start_sec) AS BIGINT) AS last_index FROM grouped WHERE pcs IS NOT NULL GROUP BY song, run HAVING count(*) >= 2",
    "p1_events": _RUNS + """SELECT song, CAST(arg_min(segment_index, start_sec) AS BIGINT) AS first_index, CAST(arg_max(segment_index, start_sec) AS BIGINT) AS last_index, max(cls) AS class_name, count(*) AS n_segments,
       round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, CAST(round(sum(coalesce(duration, end_sec - start_sec, 0)) * 1e6) AS BIGINT) AS sounding_us FROM grouped GROUP BY song, run""",
    "p2_found": _PATTERNS + "SELECT pattern FROM supports, songs WHERE 5 * support >= songs",
    "p2_support": _PATTERNS + "SELECT pattern, support, songs FROM supports, songs WHERE 5 * support >= songs",
    "p3_found": """
WITH latest AS (SELECT song, segment_index, segment_onset, n_notes, density FROM chord_review_candidates WHERE song IS NOT NULL AND segment_onset IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY song, segment_index ORDER BY loaded_at DESC) = 1)
SELECT song, row_number() OVER (PARTITION BY song ORDER BY density DESC, n_notes DESC, segment_onset, segment_index) AS place, CAST(segment_index AS BIGINT) AS segment_index
FROM latest WHERE density IS NOT NULL AND NOT isnan(density) QUALIFY place <= 5""",
    "p4_found": """
WITH a AS (SELECT DISTINCT annotation_id, song, CAST(round(onset * 1000000) AS BIGINT) AS t FROM gt_annotations WHERE lower(trim(stem)) = 'other' AND onset IS NOT NULL AND song IS NOT NULL),
n AS (SELECT DISTINCT note_id, song, CAST(round(onset * 1000000) AS BIGINT) AS t FROM other_note_tags WHERE onset IS NOT NULL AND song IS NOT NULL)
SELECT annotation_id, note_id FROM a JOIN n ON a.song = n.song AND n.t BETWEEN a.t - 50000 AND a.t + 50000
QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY abs(a.t - n.t), n.t, note_id) = 1""",
}
