"""Tables that are under their name at every instant: immutable folders and numbered commits.

    path/_commits/00000000000000000007   a small JSON object: which folder holds each bucket, and which streamed batch made it
    path/data/<id>/...                   Parquet files, never changed

A writer puts its files beside the others and then its commit under the next number, by a rename that fails if that
number is taken: of two writers that began at one version one wins, the other gets ``Conflict``. A reader takes the
highest number. A writer that stops anywhere leaves the last version as it was; ``vacuum`` removes what no commit names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.merge import merge_patches
from tallyloom.sources.jsonl import _fs
from tallyloom.sources.scratch import discard, materialize

BUCKET = "_bucket"
WHOLE = ""  # the bucket of a table without buckets


class Conflict(Exception):
    """Another writer has committed since this one read the table."""


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commits, in order."""
    return sorted(int(n) for n in _names(spark, f"{path}/_commits") if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, its commit); version 0, without folders, where nothing has been committed."""
    known = versions(spark, path)
    n = version if version is not None else known[-1] if known else 0
    if n == 0:
        return 0, {"folders": {}, "batches": {}}
    return n, json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/_commits/{n:020d}", wholetext=True).collect()))


def commit(spark: SparkSession, path: str, after: int, content: dict) -> int:
    """Puts the commit that follows version ``after`` in place, or raises ``Conflict``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _fs(spark, f"{path}/_commits/{after + 1:020d}")
    _, staged = _fs(spark, f"{path}/_commits/staging-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # nothing is overwritten
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, none)
    except Exception as e:
        fs.delete(staged, False)
        if fs.exists(target):
            raise Conflict(f"{path}: version {after + 1} is another writer's") from e
        raise
    return after + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last commit, or as of a given one."""
    n, found = manifest(spark, path, version)
    if not n:
        raise FileNotFoundError(f"{path} has no version")
    folders = sorted({f"{path}/data/{f}" for f in found["folders"].values()})
    return spark.read.schema(found["schema"]).parquet(*folders) if folders else spark.createDataFrame([], found["schema"])


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def publish(df: DataFrame, path: str, key: str | None = None, buckets: int = 64) -> int:
    """The table's whole content anew; with ``key`` dealt to buckets, so that ``merge`` rewrites only some. The input may be the table."""
    spark = df.sparkSession
    n, old = manifest(spark, path)
    folder = uuid.uuid4().hex
    at = f"{path}/data/{folder}"
    if key is None:
        df.write.parquet(at)
        folders = {WHOLE: folder}
    else:
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        df.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).option("maxRecordsPerFile", 5_000_000).parquet(at)
        folders = {name.split("=")[1]: f"{folder}/{name}" for name in _names(spark, at) if name.startswith(f"{BUCKET}=")}
    content = {"schema": _schema(df), "folders": folders, "batches": old["batches"], "key": key, "buckets": buckets if key else 0}
    return commit(spark, path, n, content)


def merge(patches: DataFrame, path: str, order: list[str], batch: tuple[str, int] | None = None) -> int:
    """J9 on a bucketed table: the buckets that the patches touch are written anew, and one commit puts all of them in place.

    ``batch``: (stream, number) of a micro-batch; one that has been committed is not merged again.
    """
    spark = patches.sparkSession
    n, old = manifest(spark, path)
    key, buckets = old["key"], old["buckets"]
    if batch is not None and old["batches"].get(batch[0], -1) >= batch[1]:
        return n
    of = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    patches = materialize(patches, "patches")
    touched = sorted(str(r[0]) for r in patches.select(of.alias("b")).distinct().collect())  # one number a bucket
    have = [b for b in touched if b in old["folders"]]
    folders = dict(old["folders"])
    if have:
        base = spark.read.schema(old["schema"]).parquet(*[f"{path}/data/{folders[b]}" for b in have])
        merged = merge_patches(base, patches, key, order)
        merged = merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema.fields], of.alias(BUCKET))
        folder = uuid.uuid4().hex
        merged.repartition(BUCKET).write.partitionBy(BUCKET).option("maxRecordsPerFile", 5_000_000).parquet(f"{path}/data/{folder}")
        folders |= {name.split("=")[1]: f"{folder}/{name}" for name in _names(spark, f"{path}/data/{folder}") if name.startswith(f"{BUCKET}=")}
    discard(patches)
    batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
    return commit(spark, path, n, old | {"folders": folders, "batches": batches})


def merge_stream(patches: DataFrame, path: str, order: list[str], checkpoint: str, name: str = "patches"):
    """Each micro-batch is one commit; a batch that is run again after an interruption changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        merge(batch, path, order, (name, number))

    return patches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes folders that none of the last ``keep`` commits names; how many. Not beside running writers or readers of older versions."""
    named = {f.split("/")[0] for n in versions(spark, path)[-keep:] for f in manifest(spark, path, n)[1]["folders"].values()}
    gone = [x for x in _names(spark, f"{path}/data") if x not in named]
    for x in gone:
        fs, p = _fs(spark, f"{path}/data/{x}")
        fs.delete(p, True)
    for x in _names(spark, f"{path}/_commits"):
        if x.startswith("staging-"):
            fs, p = _fs(spark, f"{path}/_commits/{x}")
            fs.delete(p, False)
    return len(gone)


