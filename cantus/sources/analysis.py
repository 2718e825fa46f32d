"""Audio features and analyses as JSON: typed projections, a batched source, and the sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of the service's analyses and features.
SECTION = "start double, duration double, tempo double, key int, mode int, loudness double, time_signature int, tempo_confidence double, key_confidence double"
SEGMENT = "start double, duration double, pitches array<double>, timbre array<double>, loudness_start double, loudness_max double"
FEATURES = "tempo double, key int, mode int, time_signature int, energy double, valence double, danceability double, acousticness double, instrumentalness double, loudness double"
AUDIO = ["mp3", "wav", "flac", "ogg", "m4a", "wma", "aac"]


def _rows(analyses: DataFrame, field: str, schema: str) -> DataFrame:
    parsed = F.from_json("analysis", f"{field} array<struct<{', '.join(f'{a}:{b}' for a, b in (c.split() for c in schema.split(', ')))}>>")
    return analyses.select("track_id", F.posexplode(parsed[field]).alias("place", "x")).select("track_id", "place", "x.*")


def sections(analyses: DataFrame) -> DataFrame:
    """(track_id, analysis) as one row a section; confidences may be missing. A text that is no JSON gives no row."""
    return _rows(analyses, "sections", SECTION)


def segment_pitches(analyses: DataFrame) -> DataFrame:
    """(track_id, analysis) as one row a segment with its two vectors."""
    return _rows(analyses, "segments", SEGMENT)


def track_summary(songs: DataFrame, features: DataFrame) -> DataFrame:
    """Every song with its features (track_id, features as JSON), NULL where it has none."""
    f = features.select("track_id", F.from_json("features", FEATURES).alias("f")).where("f is not null").dropDuplicates(["track_id"])
    return songs.select("track_id", "title", "artist", "duration_ms").join(f, "track_id", "left").select("track_id", "title", "artist", "f.*", "duration_ms")


def feature_batches(ids: DataFrame, fetch: Callable[[list[str]], list[dict | None]], size: int = 100) -> DataFrame:
    """(track_id, features, error) of every id, asked for ``size`` at a time; a failing batch is rows with its error, an unknown id one without features.

    ``fetch`` returns one JSON text, or None, for each id of a batch.
    """
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = pdf["track_id"].tolist()
            for at in range(0, len(names), size):
                some = names[at : at + size]
                try:
                    out = [(i, f, None) for i, f in zip(some, fetch(some), strict=True)]
                except Exception as e:  # noqa: BLE001 - isolation by batch is the contract
                    out = [(i, None, f"{type(e).__name__}: {e}") for i in some]
                yield pd.DataFrame(out, columns=["track_id", "features", "error"])

    return ids.select("track_id").where("track_id is not null").distinct().mapInPandas(ask, "track_id string, features string, error string")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a row; NULL fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def audio_files(files: DataFrame) -> DataFrame:
    """Rows whose ``path`` has one of the audio suffixes, in any case."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(AUDIO))
