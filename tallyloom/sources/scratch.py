"""Intermediates that outlive executors: written to the cluster's shared folder and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. In local mode a fresh one is made where none is set; on a cluster that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's interpreter ends."""
    folder = f"{shared_folder(spark)}/tallyloom/{spark.sparkContext.applicationId}"
    if folder not in _CLEANED:
        _CLEANED.add(folder)

        def clean() -> None:
            try:
                _delete(spark, folder)
            except Exception:  # the session has been stopped: the folder is left to the store's own cleaning
                pass

        atexit.register(clean)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back, which cuts the lineage.

    The files outlive any executor; a lost task rereads them instead of recomputing the past.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove intermediates that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            _delete(df.sparkSession, path)
