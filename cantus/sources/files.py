"""Text, CSV, JSON, array and audio sources, and the matching sinks. Schemas are given, never inferred."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "chordnotes": "segment int, onset double, offset double, pitch double, pitch_class int",
    "note_tags": "onset double, offset double, pitch int, pitch_class int, velocity int, segment_onset double, segment_offset double, chord_pitch_classes string, tag string",
    "changelog": "onset_time double, original_pitch int, corrected_pitch int, correction_type string, chord_segment_pitchclasses string, semitone_distance_moved int",
    "playlist": "track_id string, title string, artist string, artists_all array<string>, album string, duration_ms bigint, added_at string",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; an empty field is NULL. Adds the name of the folder each file lies in as ``song``."""
    df = spark.read.schema(SCHEMAS.get(schema, schema)).option("header", True).option("nullValue", "").option("recursiveFileLookup", True).csv(path)
    return df.withColumn("song", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, errors) of onset, offset, pitch, label files: rows without onset are skipped, others must be numbers with offset after onset."""
    raw = spark.read.schema("onset string, offset string, pitch string, label string").option("header", True).option("nullValue", "").option("recursiveFileLookup", True).csv(path).withColumn("file", F.col("_metadata.file_path"))
    numbers = {c: F.trim(F.col(c)).try_cast("double") for c in ("onset", "offset", "pitch")}
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    bad = F.when(given("onset") & numbers["onset"].isNull(), "onset is not a number").when(given("offset") & numbers["offset"].isNull(), "offset is not a number").when(given("pitch") & numbers["pitch"].isNull(), "pitch is not a number").when(numbers["offset"] <= numbers["onset"], "offset is not after onset")
    checked = raw.where(given("onset")).withColumn("error", bad)
    valid = checked.where("error is null").select("file", *(v.alias(c) for c, v in numbers.items()), "label")
    return valid.orderBy("file", "onset"), checked.where("error is not null")


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of songs."""
    return spark.read.schema(SCHEMAS["playlist"]).option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Distinct second fields of tab-separated lines."""
    return spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2).select(F.get("f", F.lit(1)).alias("song")).distinct()


def list_folders(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Folders under a path that hold every required file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), F.col("modificationTime").alias("at"))
    parts = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)$", 1).alias("song"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "at")
    return parts.groupBy("song").agg(F.collect_set("name").alias("names"), F.max("at").alias("at")).where(F.size(F.array_except(F.array(*map(F.lit, required)), "names")) == 0)


def first_folder_wins(files: DataFrame, folders: list[str]) -> DataFrame:
    """One path a file stem: the earlier folder in ``folders``, then the smaller path."""
    rank = F.array_position(F.array(*map(F.lit, folders)), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    w = Window.partitionBy("stem").orderBy("rank", "path")
    df = files.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).withColumn("rank", rank).where("rank > 0")
    return df.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "rank")


def _grids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        grid = np.atleast_2d(arrays[name])
                        frame, bin_ = np.indices(grid.shape)
                        yield pd.DataFrame({"path": path, "grid": name, "frame": frame.ravel(), "bin": bin_.ravel(), "level": grid.ravel().astype(float)})
            except (ValueError, OSError, zipfile.BadZipFile):
                continue


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Activation grids of npz files as (path, grid, frame, bin, level); pickled arrays are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_grids, "path string, grid string, frame int, bin int, level double")


def _mono(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            with wave.open(io.BytesIO(content)) as w:
                x = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]).reshape(-1, w.getnchannels()).astype(float)
                out.append((path, w.getframerate(), x.mean(axis=1).tolist()))
        yield pd.DataFrame(out, columns=["path", "rate", "samples"])


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """PCM wave files as (path, rate, mono samples)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_mono, "path string, rate int, samples array<double>")


def slice_audio(audio: DataFrame, start: float, end: float) -> DataFrame:
    """Samples from start to end in seconds, the end excluded."""
    a, b = F.floor(F.lit(start) * F.col("rate")), F.floor(F.lit(end) * F.col("rate"))
    return audio.withColumn("samples", F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")))


def stale(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Songs whose output is missing or older than any input, from (song, at) tables."""
    need = inputs.groupBy("song").agg(F.max("at").alias("at_in"))
    have = outputs.groupBy("song").agg(F.max("at").alias("at_out"))
    return need.join(have, "song", "left").where(F.col("at_out").isNull() | (F.col("at_out") < F.col("at_in"))).select("song")
