"""Spend ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def total(df: DataFrame, cost: str, where: str | None = None) -> DataFrame:
    """The sum, 0 for none."""
    df = df.where(where) if where else df
    return df.agg(F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 4).alias("total"))


def running(df: DataFrame, by: list[str], order: list[str], cost: str, rows: int = 1_000_000, most: int = 1_024) -> DataFrame:
    """Spend so far in each group, in two levels, so that a group of any size is dealt to many tasks.

    Ranges of the first order column (about ``rows`` each, ``most`` at most) get their sums by group, prefix sums of these tell what a
    range begins with, and a window runs inside (group, range). Equal values of that column are in one range; nulls come first.
    """
    inner = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = min(most, max(1, df.count() // rows))
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx(order[0], at, 4 * most).alias("b")).first()["b"] or [])) if at else []
    if not bounds:
        return df.withColumn("spent", F.round(F.sum(cost).over(inner.partitionBy(*by)), 4))
    kind = df.schema[order[0]].dataType
    place = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(order[0])))
    dealt = df.withColumn("_range", place)
    sums = dealt.groupBy(*by, "_range").agg(F.sum(cost).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), before.alias("_before"))
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    here = F.sum(cost).over(inner.partitionBy(*by, "_range"))
    spent = F.when(here.isNotNull() | F.col("_before").isNotNull(), F.coalesce("_before", F.lit(0.0)) + F.coalesce(here, F.lit(0.0)))
    return dealt.join(sums, on).select(*df.columns, F.round(spent, 4).alias("spent"))


def usage_totals(df: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Sums of counters, missing as 0, and requests that read the cache."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters]
    hits = [F.count_if(F.col("cached") > 0).alias("cache_hits")] if "cached" in counters else []
    return df.groupBy(*by).agg(*sums, *hits, F.count("*").alias("requests"))


def projected(df: DataFrame, cost: str, full: int) -> DataFrame:
    """The cost of a dry run carried on to the full size."""
    return df.agg(F.count("*").alias("n"), F.sum(cost).alias("_c")).select("n", F.round(F.try_divide(F.col("_c") * full, "n"), 4).alias("projected"))


def rough_tokens(df: DataFrame, texts: list[str], cap: int) -> DataFrame:
    """Characters div 4 as input tokens, half the cap a row as output tokens."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0))
    totals = df.agg(F.sum(chars).alias("_s"), F.count("*").alias("n"))
    read = F.floor(F.coalesce("_s", F.lit(0)) / 4).cast("long")
    return totals.select("n", read.alias("input_tokens"), (F.col("n") * (cap // 2)).alias("output_tokens"))
