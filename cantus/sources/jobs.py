"""Running a stage over many songs: what is left to do, dry runs, failures kept apart, sinks that add or never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FAILURES = "stage string, song string, error string, at timestamp"


def pending(jobs: DataFrame, done: DataFrame, limit: int | None = None, failed: DataFrame | None = None, retry_failed: bool = False) -> DataFrame:
    """Songs of ``jobs`` without an output in ``done``, in order, the first ``limit`` of them (the limit is the feature); songs in the failure log only with ``retry_failed``."""
    df = jobs.select("song").distinct().join(done.select("song"), "song", "left_anti")
    if failed is not None and not retry_failed:
        df = df.join(failed.select("song"), "song", "left_anti")
    df = df.orderBy("song")
    return df if limit is None else df.limit(limit)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a log, manifest or table of results; each write is one commit, so a rerun never leaves half of one."""
    df.write.mode("append").parquet(path)


def log_failures(results: DataFrame, stage: str, path: str) -> DataFrame:
    """Append the rows of ``results`` (song, error, ...) that have an error to the failure log, and return the others."""
    bad = results.where("error is not null").select(F.lit(stage).alias("stage"), "song", "error", F.current_timestamp().alias("at"))
    append_rows(bad, path)
    return results.where("error is null").drop("error")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """The failure log; empty where none has been written."""
    try:
        return spark.read.schema(FAILURES).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], FAILURES)


def clear_failures(spark: SparkSession, path: str, stage: str) -> None:
    """Forget the failures of a stage, so that it is tried again. The log is written to a new place first, then put into the old one."""
    kept = read_failures(spark, path).where(F.col("stage") != stage).collect()  # a failure log is read by people: it is small
    spark.createDataFrame(kept, FAILURES).write.mode("overwrite").parquet(path)


def scaffold(spark: SparkSession, path: str, schema: str) -> None:
    """A table with a header and no rows, only if nothing is there."""
    spark.createDataFrame([], schema).write.mode("ignore").option("header", True).csv(path)


def formatted(df: DataFrame, rates: list[str] = (), averages: list[str] = ()) -> DataFrame:
    """Rates as text with four digits, averages with two, as the reports write them."""
    return df.withColumns({c: F.format_string("%.4f", F.col(c).cast("double")) for c in rates} | {c: F.format_string("%.2f", F.col(c).cast("double")) for c in averages})


def write_in_parts(df: DataFrame, path: str, key: str, done: DataFrame | None = None) -> None:
    """Rows of the keys that are not ``done`` yet, appended and partitioned by key: what a lost run had committed stays."""
    todo = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    todo.write.mode("append").partitionBy(key).parquet(path)
