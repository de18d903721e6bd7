"""Exact ranks of large groups: histograms narrow the range of each wanted value, for all groups at once.

The first pass takes each group's count, least and largest value. Where a group has more than ``small`` values, a
histogram of ``BINS`` bins of equal width tells the bin that holds a wanted rank, and the least and largest value in that bin are
the next range; bins keep the order of values, so the rank within the bin is known. A range of one value is
the answer; ranges of ``small`` values at most are numbered in a window. Nothing is gathered: a task holds a
histogram, or sorts rows of groups (Spark spills them), and each round is a scan of the keys and the one value column.

Nulls don't count; NaN is the largest value; a null group is a group; a group without values has n = 0 and null answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tallyloom.sources.scratch import discard, materialize

BINS, SMALL, FEW = 1024, 100_000, 100_000
Place = Callable[[Column], Column]


def nearest(p: float) -> Place:
    """The index rounded half to even."""
    return lambda n: F.bround(F.lit(p) * (n - 1)).cast("long")


def trunc(p: float) -> Place:
    """The index floor(p n), the last at most."""
    return lambda n: F.least(F.floor(F.lit(p) * n), n - 1)


def below(p: float) -> Place:
    return lambda n: F.floor(F.lit(p) * (n - 1))


def above(p: float) -> Place:
    return lambda n: F.ceil(F.lit(p) * (n - 1))


def _bin(v: Column, lo: Column, hi: Column, real: bool) -> Column:
    """The bin of v in lo..hi; it never falls as v grows."""
    if real:
        finite = lambda c: F.greatest(F.least(F.nanvl(c.cast("double"), F.lit(1.7e308)), F.lit(1.7e308)), F.lit(-1.7e308)) / 2
        part = F.try_divide(finite(v) - finite(lo), finite(hi) - finite(lo))
    else:
        exact = lambda c: c.cast("decimal(38,10)")
        part = (exact(v) - exact(lo)).cast("double") / (exact(hi) - exact(lo)).cast("double")
    inner = F.least(F.greatest(F.floor(F.coalesce(part, F.lit(0.5)) * (BINS - 2)).cast("int") + 1, F.lit(1)), F.lit(BINS - 2))
    return F.when(v == lo, 0).when(v == hi, BINS - 1).otherwise(inner)


def _beside(left: DataFrame, right: DataFrame, by: list[str], also: Column, how: str = "inner", few: bool = False) -> DataFrame:
    """A join on equal groups, nulls included, and ``also``; the other columns of ``right`` must have names of their own."""
    right = right.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    for i, c in enumerate(by):
        also = also & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    return left.join(F.broadcast(right) if few else right, also, how).drop(*[f"_g{i}" for i in range(len(by))])


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of a row a group as one; a null group is a group."""
    return _beside(left, right, by, F.lit(True), few=not by)


def _meet(rows: DataFrame, asks: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the ranges of their group that hold them; few ranges (counted) are broadcast, so that only those rows move."""
    ranges = asks.select(*by, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).distinct()
    few = not by or ranges.count() <= FEW
    return _beside(rows, ranges if few else ranges.hint("shuffle_hash"), by, (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to")), few=few)


def ranked(df: DataFrame, by: list[str], value: str, places: dict[str, Place], small: int = SMALL, also: list[Column] | None = None) -> DataFrame:
    """``by``, n (values of the group), aggregates of the group (``also``) and, for each of ``places``, the value at that place (from 0)."""
    rows = df.select(*by, F.col(f"`{value}`").alias("_v")).where("_v is not null")
    real = isinstance(rows.schema["_v"].dataType, (DoubleType, FloatType))
    groups = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), *(also or []))
    groups = materialize(groups, "rank-groups")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pick"), f(F.col("n")).cast("long").alias("rank")) for k, f in places.items()]))
    asks = groups.where("n > 0").select(*by, F.col("n").alias("_left"), "_lo", "_hi", each.alias("_p")).select(*by, "_left", "_lo", "_hi", "_p.pick", "_p.rank")
    asks = materialize(asks, "rank-asks")
    same = F.col("_lo").eqNullSafe(F.col("_from")) & F.col("_hi").eqNullSafe(F.col("_to"))
    while not (wide := asks.where((F.col("_left") > small) & (F.col("_lo") != F.col("_hi")))).isEmpty():
        bins = _meet(rows, wide, by).groupBy(*by, "_from", "_to", _bin(F.col("_v"), F.col("_from"), F.col("_to"), real).alias("_bin"))
        bins = bins.agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "_from", "_to").orderBy("_bin"))  # BINS rows at most
        bins = materialize(bins.withColumn("_before", upto - F.col("_c")), "rank-bins")
        inside = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_c"))
        hit = _beside(wide, bins, by, same & inside)
        hit = hit.select(*by, F.col("_c").alias("_left"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "pick", (F.col("rank") - F.col("_before")).alias("rank"))
        kept = asks.where((F.col("_left") <= small) | (F.col("_lo") == F.col("_hi")))
        before, asks = asks, materialize(kept.unionByName(hit), "rank-asks")
        discard(before, bins)
    found = asks.where("_lo = _hi").select(*by, "pick", F.col("_lo").alias("_v"))
    rest = asks.where("_lo != _hi")
    met = _meet(rows, rest, by)
    met = met.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_from", "_to").orderBy("_v")).cast("long") - 1)
    hit = _beside(rest, met, by, same & (F.col("rank") == F.col("_at"))).select(*by, "pick", "_v")
    answers = found.unionByName(hit).groupBy(*by).agg(*[F.max(F.when(F.col("pick") == k, F.col("_v"))).alias(k) for k in places])
    shown = [c for c in groups.columns if c not in ("_lo", "_hi")]
    return _beside(groups, answers, by, F.lit(True), "left", few=not by).select(*[f"`{c}`" for c in shown], *places)


def interpolated(low: Column, high: Column, n: Column, p: float) -> Column:
    """The value at place p (n - 1) between its two neighbours; null without values."""
    at = F.lit(p) * (n - 1)
    down, up = F.floor(at), F.ceil(at)
    between = (up - at) * low.cast("double") + (at - down) * high.cast("double")
    return F.when(down == up, low.cast("double")).otherwise(between)


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], small: int = SMALL, also: list[Column] | None = None) -> DataFrame:
    """``by``, n, aggregates and linearly interpolated percentiles (A28); null without values."""
    places = {f"_{k}_{side}": f(p) for k, p in wanted.items() for side, f in (("below", below), ("above", above))}
    r = ranked(df, by, value, places, small, also)
    return r.select(*[f"`{c}`" for c in r.columns if c not in places], *[interpolated(F.col(f"_{k}_below"), F.col(f"_{k}_above"), F.col("n"), p).alias(k) for k, p in wanted.items()])
