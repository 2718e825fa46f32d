"""Chord segments with one identity per row, shared by the run and the pattern operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.functions.chords import absolute_masks, normal_class, parse_set, rotate, zero_masks

NEEDED = ("song", "segment_index", "start_sec", "end_sec", "duration", "pitch_class_set", "forte_class", "root_pc", "loaded_at")


def identified(segments: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per (song, segment_index): start_sec, end_sec, duration, mask, class_name.

    mask is the 12-bit pitch-class set, from pitch_class_set or else from class and
    root; class_name is the written class or else the one that follows from the set.
    Deliveries of one segment are combined field by field, the latest delivery that
    has the field first. Rows without song, segment_index or start_sec have no place
    in a sequence and are left out. Extra columns are ignored.
    """
    zero = zero_masks(segments.sparkSession, classes)
    df = segments.select(*NEEDED).where(F.col("song").isNotNull() & F.col("segment_index").isNotNull() & F.col("start_sec").isNotNull() & ~F.isnan("start_sec"))
    df = df.withColumn("class_name", normal_class(F.col("forte_class"))).withColumn("own", parse_set(F.col("pitch_class_set")))
    # both lookups have at most 108 rows
    df = df.join(F.broadcast(zero), "class_name", "left")
    df = df.withColumn("mask", F.coalesce("own", rotate(F.col("zero_mask"), F.pmod("root_pc", F.lit(12)))))
    df = df.join(F.broadcast(absolute_masks(zero)), "mask", "left")
    df = df.withColumn("class_name", F.when(F.col("zero_mask").isNotNull(), F.col("class_name")).otherwise(F.col("class_of_mask")))
    at = F.struct(F.col("loaded_at"), F.col("own").isNotNull(), F.col("mask"), F.col("class_name"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return df.groupBy("song", F.col("segment_index").cast("bigint").alias("segment_index")).agg(*(latest(c) for c in ("start_sec", "end_sec", "duration", "mask", "class_name")))


def in_order(df: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by (song, start_sec, segment_index): a song may span many partitions."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ("song", "start_sec", "segment_index")
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
