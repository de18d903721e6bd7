"""Writers: staged replacement, routing, sidecars, manifests; all through Hadoop's file systems."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.jsonl import _fs, exists, read_sidecar


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """K1."""
    df.write.mode("append").format(form).save(path)


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    """K2: written beside the target, which then steps aside for it. The input may be the target.

    A folder can't be renamed over another: between the two renames there is no table under the name, and no moment
    without the old table or the new one on disk. ``recover`` undoes an interruption there; every replacement begins with it.
    """
    spark = df.sparkSession
    recover(spark, path)
    staged, previous = f"{path}._staging-{uuid.uuid4().hex}", f"{path}._previous-{uuid.uuid4().hex}"
    df.write.format(form).save(staged)
    fs, target = _fs(spark, path)
    _, source = _fs(spark, staged)
    _, old = _fs(spark, previous)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not rename {staged} to {path}")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """The table that an interrupted replacement left aside is put back; whether there was one."""
    fs, target = _fs(spark, path)
    parent = target.getParent()
    if not fs.exists(parent):
        return False
    aside = [s.getPath() for s in fs.listStatus(parent) if s.getPath().getName().startswith(f"{target.getName()}._previous-")]
    back = bool(aside) and not fs.exists(target) and fs.rename(aside[0], target)
    for p in aside:
        fs.delete(p, True)  # of a finished replacement
    return back


def clean_staging(spark: SparkSession, folder: str) -> int:
    """K4: removes what interrupted replacements have left."""
    fs, p = _fs(spark, folder)
    stale = [s.getPath() for s in fs.listStatus(p) if "._staging-" in s.getPath().getName()] if fs.exists(p) else []
    for s in stale:
        fs.delete(s, True)
    return len(stale)


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """K6: refuses to write over anything."""
    df.write.mode("errorifexists").format(form).save(path)


def write_if_absent(df: DataFrame, path: str, force: bool = False, form: str = "parquet") -> bool:
    """K7: whether it wrote."""
    if exists(df.sparkSession, path) and not force:
        return False
    replace(df, path, form)
    return True


def write_routes(df: DataFrame, path: str, route: str = "route") -> None:
    """K8/K9: one partitioned write for all routes."""
    df.write.mode("append").partitionBy(route).parquet(path)


def _over(spark: SparkSession, staged, target) -> None:
    """One file renamed over another, at once where the store can."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, options)


def overwrite_named(spark: SparkSession, paths: list[str]) -> int:
    """K5: before a forced run, exactly the listed outputs go; how many there were."""
    gone = 0
    for path in paths:
        fs, p = _fs(spark, path)
        gone += bool(fs.exists(p) and fs.delete(p, True))
    return gone


def copy_counted(spark: SparkSession, paths: list[str], into: str) -> DataFrame:
    """Files copied into a folder of any store, with their sizes; (name, bytes, state), nothing raises for one file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for path in paths:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            rows.append((p.getName(), None, "missing"))
            continue
        to, target = _fs(spark, f"{into.rstrip('/')}/{p.getName()}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, target, False, True, conf)
        rows.append((p.getName(), to.getContentSummary(target).getLength(), "copied"))
    return spark.createDataFrame(rows, "name string, bytes long, state string")


def sorted_write(df: DataFrame, path: str, key: list[str], form: str = "parquet") -> None:
    """The files in order of the key, and rows in order inside each: a range partitioning, no task sorts the whole."""
    replace(df.repartitionByRange(*key).sortWithinPartitions(*key), path, form)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """K3: one small JSON value, replaced by rename."""
    fs, target = _fs(spark, path)
    _, staged = _fs(spark, f"{path}._staging-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.close()
    _over(spark, staged, target)


def upsert_json(spark: SparkSession, path: str, key: str, entry: dict) -> dict:
    """One entry of a small keyed object, merged into what is there."""
    whole = read_sidecar(spark, path)
    whole[key] = whole.get(key, {}) | entry
    write_json(spark, whole, path)
    return whole


def archive(spark: SparkSession, folder: str, suffix: str, into: str) -> int:
    """Moves the folder's own files of a suffix; idempotent, not recursive."""
    fs, p = _fs(spark, folder)
    _, target = _fs(spark, into)
    fs.mkdirs(target)
    jvm = spark.sparkContext._jvm
    found = [s.getPath() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(suffix)]
    for f in found:
        fs.rename(f, jvm.org.apache.hadoop.fs.Path(target, f.getName()))
    return len(found)


def table_digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of their contents: one pass, no sort."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).alias("summed"))


def file_sha256(spark: SparkSession, path: str) -> str:
    """H6 for files of sidecar size."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return hashlib.sha256(bytes(content)).hexdigest()


def manifest(spark: SparkSession, folder: str, names: dict[str, str]) -> DataFrame:
    """(local, remote, bytes, state) of the files to publish; missing ones are marked, nothing is sent."""
    fs, p = _fs(spark, folder)
    have = {s.getPath().getName(): s.getLen() for s in fs.listStatus(p)} if fs.exists(p) else {}
    rows = [(k, v, have.get(k), "present" if k in have else "missing") for k, v in names.items()]
    return spark.createDataFrame(rows, "local string, remote string, bytes long, state string")


def report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; a result of more than ``most`` rows is refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate them, or write a table")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"
