"""The music model on the delivered tables: segments and notes with one identity each, times in microseconds.

``SEGMENTS_SQL`` and ``NOTES_SQL`` are the same views in SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.functions.chords import absolute_masks, normal_class, parse_set, rotate, zero_masks
from cantus.plans.storage import table


def micros(seconds: str | Column) -> Column:
    return F.round((F.col(seconds) if isinstance(seconds, str) else seconds) * 1_000_000).cast("bigint")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """song, idx, start_us, end_us, mask, cls, root: class and root follow from the set alone (lowest root of a symmetric set)."""
    zero = zero_masks(spark, table(spark, d, "chord_classes"))
    df = table(spark, d, "chord_sequences").where("song is not null and segment_index is not null and start_sec is not null")
    df = df.select("song", F.col("segment_index").cast("bigint").alias("idx"), micros("start_sec").alias("start_us"), micros("end_sec").alias("end_us"), parse_set(F.col("pitch_class_set")).alias("own"), normal_class(F.col("forte_class")).alias("class_name"), F.pmod("root_pc", F.lit(12)).alias("r"))
    df = df.join(F.broadcast(zero), "class_name", "left").withColumn("mask", F.coalesce("own", rotate(F.col("zero_mask"), F.col("r"))))
    df = df.groupBy("song", "idx").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("mask").alias("mask"))
    return df.join(F.broadcast(absolute_masks(zero)), "mask", "left").select("song", "idx", "start_us", "end_us", "mask", F.col("class_of_mask").alias("cls"), F.col("root_of_mask").alias("root"))


SEGMENTS_SQL = """
zero AS (SELECT forte_class AS cls, list_transform(string_split(root_zero_set, ','), lambda x: CAST(x AS INT)) AS pcs FROM chord_classes),
rolled AS (SELECT cls, r.root AS root, CAST(list_sum(list_transform(pcs, lambda x: CAST(1 AS BIGINT) << ((x + r.root) % 12))) AS INT) AS mask FROM zero, (SELECT unnest(range(12)) AS root) r),
canon AS (SELECT mask, arg_min(cls, root) AS cls, CAST(min(root) AS INT) AS root FROM rolled GROUP BY mask),
raw_seg AS (SELECT song, CAST(segment_index AS BIGINT) AS idx, CAST(round(start_sec * 1000000) AS BIGINT) AS start_us, CAST(round(end_sec * 1000000) AS BIGINT) AS end_us,
  CAST(list_sum(list_transform(list_distinct(regexp_extract_all(pitch_class_set, '[0-9]+')), lambda x: CAST(1 AS BIGINT) << (CAST(x AS INT) % 12))) AS INT) AS own,
  root_pc % 12 AS r, regexp_replace(upper(forte_class), '[^0-9A-Z]', '', 'g') AS spelled FROM chord_sequences WHERE song IS NOT NULL AND segment_index IS NOT NULL AND start_sec IS NOT NULL),
seg AS (SELECT g.song, g.idx, g.start_us, g.end_us, g.mask, canon.cls, canon.root FROM
  (SELECT s.song, s.idx, min(start_us) AS start_us, max(end_us) AS end_us, max(coalesce(own, rolled.mask)) AS mask
   FROM raw_seg s LEFT JOIN rolled ON replace(rolled.cls, '-', '') = s.spelled AND rolled.root = s.r GROUP BY s.song, s.idx) g LEFT JOIN canon ON canon.mask = g.mask)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """song, note_id, onset_us, offset_us, pitch, velocity: one row a note with an onset."""
    df = table(spark, d, "other_note_tags").where("song is not null and onset is not null and note_id is not null and pitch is not null")
    return df.groupBy("note_id").agg(F.min("song").alias("song"), F.min(micros("onset")).alias("onset_us"), F.max(micros("offset_sec")).alias("offset_us"), F.min("pitch").alias("pitch"), F.max("velocity").alias("velocity"))


NOTES_SQL = """
note AS (SELECT note_id, min(song) AS song, min(CAST(round(onset * 1000000) AS BIGINT)) AS onset_us, max(CAST(round(offset_sec * 1000000) AS BIGINT)) AS offset_us, min(pitch) AS pitch, max(velocity) AS velocity
  FROM other_note_tags WHERE song IS NOT NULL AND onset IS NOT NULL AND note_id IS NOT NULL AND pitch IS NOT NULL GROUP BY note_id)"""


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """annotation_id, song, stem, onset_us, offset_us, pitch: one row an annotation, stem in plain spelling."""
    df = table(spark, d, "gt_annotations").where("annotation_id is not null and song is not null")
    return df.groupBy("annotation_id").agg(F.min("song").alias("song"), F.min(F.lower(F.trim("stem"))).alias("stem"), F.min(micros("onset")).alias("onset_us"), F.max(micros("offset_sec")).alias("offset_us"), F.min("pitch").alias("pitch"))


ANNOTATIONS_SQL = """
gt AS (SELECT annotation_id, min(song) AS song, min(lower(trim(stem))) AS stem, min(CAST(round(onset * 1000000) AS BIGINT)) AS onset_us, max(CAST(round(offset_sec * 1000000) AS BIGINT)) AS offset_us, min(pitch) AS pitch
  FROM gt_annotations WHERE annotation_id IS NOT NULL AND song IS NOT NULL GROUP BY annotation_id)"""
