"""Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.merge import merge_patches
from tallyloom.sources.jsonl import _fs
from tallyloom.sources.scratch import discard, materialize
from tallyloom.sources.sinks import replace


def log_stream(spark: SparkSession, path: str, schema: str, form: str = "json", files: int = 100) -> DataFrame:
    """An append-only folder as a stream."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(path)


def table_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isFile():  # a stream reads folders
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def pending_stream(work: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Resume by skip set: each key once; state goes with the watermark."""
    return work.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def spend_stream(ledger: DataFrame, ts: str, late: str, window: str, by: list[str], cost: str) -> DataFrame:
    """Spend by window and group, late rows within the watermark counted."""
    g = ledger.withWatermark(ts, late).groupBy(F.window(ts, window), *by)
    return g.agg(F.round(F.sum(cost), 4).alias("spent"), F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "spent", "n")


BUCKET = "_bucket"


def write_buckets(df: DataFrame, target: str, key: str, buckets: int = 256) -> None:
    """A table for ``upsert_stream``, in folders by a hash of the key, so that a micro-batch rewrites only those it touches."""
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    d = df.withColumn(BUCKET, bucket)
    d.repartition(BUCKET).write.partitionBy(BUCKET).option("maxRecordsPerFile", 5_000_000).parquet(target)


def upsert_stream(patches: DataFrame, target: str, key: str, order: list[str], checkpoint: str):
    """Idempotent upserts: each micro-batch merges into the table; a replayed batch changes nothing.

    Of a table of ``write_buckets`` only the folders with patched keys are read and overwritten; any other is replaced whole.
    """

    def like(df: DataFrame, base: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema.fields])

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(target)
        if BUCKET not in base.columns:
            replace(like(merge_patches(base, batch, key, order), base), target)
            return
        batch = materialize(batch, "patches")
        some = base.join(batch.select(key), key, "left_semi").select(BUCKET).distinct()
        touched = [r[0] for r in some.collect()]  # one number a bucket
        part = base.where(F.col(BUCKET).isin(touched))
        part = materialize(like(merge_patches(part, batch, key, order), base), "patched")
        part.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(target)
        discard(batch, part)

    return patches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_stream(errors: DataFrame, key: str, ts: str, late: str, attempts: int = 2) -> DataFrame:
    """Keys whose failures reach the limit inside the watermark: the dead letters."""
    g = errors.withWatermark(ts, late).groupBy(key, F.session_window(ts, late))
    return g.agg(F.count("*").alias("failures")).where(F.col("failures") >= attempts).select(key, "failures")


def phase_states(events: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """The state machine's table: the latest status of each phase (update mode)."""
    return events.groupBy(key).agg(F.max_by(status, ts).alias("status"), F.max(ts).alias("updated"))
