"""Streams of notes: tagging against known segments, and densities in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.plans.harmony import has

CELL_US = 10_000_000


def tag_stream(notes: DataFrame, segments: DataFrame) -> DataFrame:
    """Streamed notes (song, onset_us, pitch, ...) tagged by a static table of disjoint segments: a stream-static join on time cells."""
    cells = F.explode(F.sequence(F.floor(F.col("start_us") / CELL_US).cast("bigint"), F.floor((F.col("end_us") - 1) / CELL_US).cast("bigint")))
    known = segments.where("end_us > start_us and mask is not null").select(F.col("song"), cells.alias("cell"), "start_us", "end_us", "mask")
    asked = notes.withColumn("cell", F.floor(F.col("onset_us") / CELL_US).cast("bigint"))
    hit = (asked.song == known.song) & (asked.cell == known.cell) & (asked.onset_us >= known.start_us) & (asked.onset_us < known.end_us)
    df = asked.join(known, hit, "left").select(*(asked[c] for c in notes.columns), known.mask)
    return df.withColumn("tag", F.when(F.col("mask").isNull(), "no_chord_data").when(has(F.col("mask"), F.col("pitch")), "chord_tone").otherwise("non_chord_tone"))


def density_stream(tagged: DataFrame, time: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Share of notes outside the chord per song and window of event time; rows later than ``late`` are dropped by the watermark."""
    df = tagged.where("tag <> 'no_chord_data'").withWatermark(time, late)
    counts = df.groupBy(F.window(time, width), "song").agg(F.count("*").alias("n_notes"), F.count_if(F.col("tag") == "non_chord_tone").alias("n_outside"))
    return counts.select("window.start", "song", "n_notes", "n_outside", (F.col("n_outside") / F.col("n_notes")).alias("density"))
