"""Seeded sampling, quotas and allocation; order is always a hash of the key, so results repeat at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import hash_order


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def stratified(df: DataFrame, strata: list[str], key: str, seed: object, target: int | DataFrame) -> DataFrame:
    """``target`` rows of each stratum in hash order, all where there are fewer.

    ``target``: a number, or a frame of the strata columns and ``target``. A rank limit is pushed below the shuffle
    (WindowGroupLimit) where the target is a number.
    """
    order = hash_order(seed, *_cols(strata), F.col(key))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(order, F.col(key)))
    if isinstance(target, int):
        return df.withColumn("_n", place).where(F.col("_n") <= target).drop("_n")
    # The largest target as a literal keeps the rank limit below the shuffle; then each stratum's own applies.
    size = target.agg(F.max("target").alias("most"), F.count("*").alias("n")).first()
    ranked = df.withColumn("_n", place).where(F.col("_n") <= F.lit(int(size["most"] or 0)))
    spec = F.broadcast(target) if size["n"] <= 10_000 else target
    return ranked.join(spec, strata).where(F.col("_n") <= F.col("target")).drop("_n", "target")


def shortfall(df: DataFrame, strata: list[str], target: int) -> DataFrame:
    """A6/W2's guard: strata with fewer rows than the target: strata, n, missing."""
    return df.groupBy(*strata).agg(F.count("*").alias("n")).where(F.col("n") < target).withColumn("missing", target - F.col("n"))


def top_by_hash(df: DataFrame, key: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The first n in order of sha1(key), of all or by group."""
    if not by:
        return df.orderBy(F.sha1(F.col(key).cast("string")), key).limit(n)
    w = Window.partitionBy(*by).orderBy(F.sha1(F.col(key).cast("string")), F.col(key))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cap_per_group(df: DataFrame, group: str, key: str, k: int, seed: object) -> DataFrame:
    """At most k rows a group."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, F.col(key)), F.col(key))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def largest_remainder(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Integer shares of ``total`` by weight: (name, weight, target). Ties go to the larger weight, then the name.

    A row a name: the window sees the names only.
    """
    w = weights.groupBy(name).agg(F.sum(F.col(weight).cast("long")).alias(weight))
    whole = Window.partitionBy(F.lit(1))
    w = w.withColumn("_sum", F.sum(weight).over(whole)).withColumn("_x", F.col(weight) * F.lit(total))
    w = w.withColumn("_base", F.coalesce(F.expr("try_divide(_x - pmod(_x, _sum), _sum)").cast("long"), F.lit(0).cast("long")))
    w = w.withColumn("_rest", F.col("_x") - F.col("_base") * F.col("_sum")).withColumn("_left", F.lit(total) - F.sum("_base").over(whole))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_rest"), F.desc(weight), F.asc(name)))
    got = F.col("_base") + ((rank <= F.col("_left")) & (F.col("_sum") > 0)).cast("long")
    return w.select(name, weight, got.alias("target"))


def equal_quota(names: DataFrame, name: str, total: int) -> DataFrame:
    """Total div n each, the last name takes the rest."""
    w = Window.partitionBy(F.lit(1))
    names = names.select(name).distinct().withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(name)))
    each = F.floor(F.lit(total) / F.col("_n")).cast("long")
    return names.select(name, F.when(F.col("_i") == F.col("_n"), F.lit(total) - each * (F.col("_n") - 1)).otherwise(each).alias("quota"))


def ceil_quota_then_trim(df: DataFrame, cells: list[str], key: str, n: int, seed: object) -> DataFrame:
    """ceil(n / cells) of each cell, then the first n of all in hash order."""
    count = df.select(*cells).distinct().count()
    each = -(-n // max(count, 1))
    return stratified(df, cells, key, seed, each).orderBy(hash_order(seed, F.col(key)), key).limit(n)


def holdout(df: DataFrame, pool: Column, targets: dict[str, int], group: str, key: str, seed: object) -> tuple[DataFrame, DataFrame]:
    """(held out, rest): targets of each group among the rows of the pool, and what isn't held out."""
    spec = df.sparkSession.createDataFrame(sorted(targets.items()), f"{group} string, target long")
    held = stratified(df.where(pool), [group], key, seed, spec)
    return held, df.join(held.select(key), key, "left_anti")


def visit_order(df: DataFrame, key: str, seed: object, waiting: Column) -> DataFrame:
    """Rows still waiting with their place among all rows: the order doesn't move when rows get done."""
    return df.withColumn("place", hash_order(seed, F.col(key))).where(waiting)


def chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Chunk numbers of ``size`` rows in key order, without gathering rows: ranges of about 100,000 rows (4,096 ranges at
    most) get their offsets from counts."""
    w = Window.partitionBy("_b").orderBy(key)
    ranges = min(4096, max(1, df.count() // 100_000))
    bounds = (df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 4 * 4096).alias("b")).first()["b"] if ranges > 1 else None) or []
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    parts = df.withColumn("_b", bucket)
    before = parts.groupBy("_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_o", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_b")) - F.col("_n")).select("_b", "_o")
    out = parts.join(F.broadcast(before), "_b")  # a row a range
    return out.withColumn("chunk", F.floor((F.row_number().over(w) + F.col("_o") - 1) / size).cast("long")).drop("_b", "_o")
