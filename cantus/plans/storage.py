"""Lineage cuts: tables written to the folder the cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Only in local mode, where driver
and executors are one machine, a folder of our own is used if that setting is absent.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import cantus

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(cantus)

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for lineage cuts; one of our own only in local mode, if none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"cantus-{os.getuid()}-{os.getpid()}")
    return folder.rstrip("/")


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike ``localCheckpoint`` it survives the loss of any executor, and unlike
    ``persist`` it never recomputes, which matters behind a range exchange whose
    boundaries are sampled.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cantus-cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    _written[path] = spark
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cantus_cut = path
    return out


def release(*cuts: DataFrame) -> None:
    """Delete cuts whose every consumer has been written; the others go when the session ends."""
    for df in cuts:
        path = getattr(df, "_cantus_cut", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        return


@atexit.register
def _release() -> None:
    for path, spark in _written.items():
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than that (so it is small); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
