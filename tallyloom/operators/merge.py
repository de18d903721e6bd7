"""Merging, comparing and resuming keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by an explicit order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_patches(base: DataFrame, patches: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Base rows with the columns of their last patch written over them, nulls included; keys meet as strings.

    Patches without a base row are dropped (count them with ``merge_counts``).
    """
    columns = [c for c in patches.columns if c != key and c not in order and c in base.columns]
    new = [c for c in patches.columns if c != key and c not in order and c not in base.columns]
    last = last_write(patches, [key], order).select(F.col(key).cast("string").alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in columns + new])
    joined = base.join(last, F.col(key).cast("string") == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    out = [F.when(hit, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*out, *[F.col(f"_p_{c}").alias(c) for c in new])


def merge_counts(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """J9's counters: base rows, patch rows, keys patched, patches without a base row."""
    b = base.select(F.col(key).cast("string").alias("k")).groupBy("k").agg(F.count("*").alias("b"))
    p = patches.select(F.col(key).cast("string").alias("k")).groupBy("k").agg(F.count("*").alias("p"))
    both = b.join(p, "k", "full")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(z("b").alias("base_rows"), z("p").alias("patch_rows"), F.count_if(F.expr("b is not null and p is not null")).alias("patched"), z(F.when(F.col("b").isNull(), F.col("p"))).alias("unmatched"))


def compare_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Outcome per key of two runs with verdict and confidence; a flip outranks a confidence shift; null equals null."""
    x = a.select(key, F.col("verdict").alias("va"), F.col("confidence").alias("ca"), F.lit(1).alias("ha"))
    y = b.select(key, F.col("verdict").alias("vb"), F.col("confidence").alias("cb"), F.lit(1).alias("hb"))
    j = x.join(y, key, "full")
    outcome = (
        F.when(F.col("ha").isNull(), "only_b").when(F.col("hb").isNull(), "only_a").when(~F.col("va").eqNullSafe(F.col("vb")), "verdict_flip")
        .when(~F.col("ca").eqNullSafe(F.col("cb")), "confidence_shift").otherwise("identical")
    )
    return j.select(key, "va", "vb", "ca", "cb", outcome.alias("outcome"))


def pending(work: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """What none of the done tables has; their keys are read as strings, missing keys ignored."""
    for d in done:
        seen = d.select(F.col(key).cast("string").alias("_k")).where("_k is not null").distinct()
        work = work.join(seen, F.col(key).cast("string") == F.col("_k"), "left_anti")
    return work


def worklist(questions: DataFrame, models: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Every question with every model (a dimension of checked size) but what is done."""
    n = models.count()
    if n > 10_000:
        raise ValueError(f"{n} models: a worklist multiplies questions by a small dimension")
    return questions.crossJoin(F.broadcast(models)).join(done.select(*on).distinct(), on, "left_anti")


def doubled(df: DataFrame) -> DataFrame:
    """Each row plain and swapped."""
    return df.withColumn("swap", F.explode(F.array(F.lit(False), F.lit(True))))


def wide_by(df: DataFrame, key: str, label: Column, value: str, names: list[str]) -> DataFrame:
    """One row a key with a column a pass, by one aggregation instead of a join a pass."""
    return df.groupBy(key).agg(*[F.max(F.when(label == n, F.col(value))).alias(n) for n in names])


def lookup(df: DataFrame, dim: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(matched with the dimension's columns, rows without a match); the size of the dimension decides the join."""
    marked = dim.withColumn("_hit", F.lit(True))
    j = df.join(marked, key, "left")
    return j.where("_hit").drop("_hit"), j.where("_hit is null").select(*df.columns)


def terminal_failures(errors: DataFrame, done: DataFrame, key: str, attempts: int = 2) -> DataFrame:
    """Keys that failed ``attempts`` times and never succeeded."""
    return errors.groupBy(key).agg(F.count("*").alias("failures")).where(F.col("failures") >= attempts).join(done.select(key).distinct(), key, "left_anti")
