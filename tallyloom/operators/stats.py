"""Percentiles, length statistics and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ranks


def percentile_linear(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Exact, interpolated; 0 for none."""
    return ranks.percentiles(df, by, value, {"percentile": p}).withColumn("percentile", F.coalesce("percentile", F.lit(0.0)))


def percentile_nearest(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Exact nearest rank with the index rounded half to even; null for none."""
    return ranks.ranked(df, by, value, {"percentile": ranks.nearest(p)})


def percentile_trunc(df: DataFrame, by: list[str], value: str, p: float, also: list[Column] | None = None) -> DataFrame:
    """The value at index floor(p n), null for none."""
    return ranks.ranked(df, by, value, {"percentile": ranks.trunc(p)}, also=also)


def percentile_scale(c: Column, p: float, accuracy: int = 100_000) -> Column:
    """An approximation in one pass: bounded memory, rank error 1 / accuracy."""
    return F.percentile_approx(c, F.lit(p), accuracy)


def length_summary(df: DataFrame, by: list[str], length: str) -> DataFrame:
    """N, mean, median, p90."""
    r = ranks.percentiles(df, by, length, {"median": 0.5, "p90": 0.9}, also=[F.round(F.avg(length), 6).alias("mean")])
    return r.select(*by, "n", "mean", "median", F.coalesce("p90", F.lit(0.0)).alias("p90"))


def medians(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: the median of each column under its name."""
    parts = [ranks.percentiles(df, [], c, {name: 0.5}).select(name) for name, c in columns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def median_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Medians of two columns and their ratio."""
    return medians(df, {"median_a": a, "median_b": b}).withColumn("ratio", F.round(F.try_divide("median_a", "median_b"), 9))


def divergence(df: DataFrame, group: str, value: str) -> DataFrame:
    """Largest over smallest median of the groups."""
    m = ranks.percentiles(df, [group], value, {"m": 0.5})
    return m.agg(F.min("m").alias("low"), F.max("m").alias("high")).withColumn("divergence", F.round(F.try_divide("high", "low"), 9))


def length_ratios(df: DataFrame, a: str, b: str) -> DataFrame:
    """Ratios of the medians and of the 90th percentiles of two columns."""
    x, y = (ranks.percentiles(df, [], c, {f"{s}_median": 0.5, f"{s}_p90": 0.9}).drop("n") for s, c in (("x", a), ("y", b)))
    return x.crossJoin(F.broadcast(y)).select((F.col("x_median") / F.col("y_median")).alias("median_ratio"), (F.col("x_p90") / F.col("y_p90")).alias("p90_ratio"))  # one row each


def source_mix(df: DataFrame, source: str) -> DataFrame:
    """Counts and percentages."""
    g = df.groupBy(source).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select(source, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))  # one row


def pattern_hits(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """Fields (not rows) that match."""
    hits = sum((F.coalesce(F.col(c).rlike(pattern), F.lit(False)).cast("int") for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(hits), F.lit(0)).alias("hits"), F.count("*").alias("n"))


def throughput(df: DataFrame, by: list[str], seconds: str, tokens: str) -> DataFrame:
    """A36."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(seconds).alias("_s"), F.sum(tokens).alias("_t"))
    return g.select(*by, "n", F.round(F.try_divide(F.col("n") * 60, "_s"), 4).alias("per_minute"), F.round(F.try_divide("_t", "_s"), 4).alias("tokens_per_second"))


def latency(df: DataFrame, by: list[str], total: str, first: str, failed: str, degraded: str, tokens: str) -> DataFrame:
    """First-token percentiles skip degraded calls; totals skip failed ones."""
    ok = ~F.col(failed)
    t, f = F.when(ok, F.col(total)), F.when(ok & ~F.col(degraded), F.col(first))
    calls = df.select(*by, failed, F.when(ok, F.col(tokens)).alias("_tokens"), t.alias("_total"), f.alias("_first"))
    speed = F.round(F.try_divide(F.sum("_tokens"), F.sum("_total")), 6).alias("tokens_per_second")
    also = [F.count("*").alias("calls"), F.count_if(F.col(failed)).alias("failures"), speed]
    at = lambda side: {f"{side}_p50": ranks.nearest(0.5), f"{side}_p95": ranks.nearest(0.95)}
    whole = ranks.ranked(calls, by, "_total", at("total"), also=also).drop("n")
    out = ranks.beside(whole, ranks.ranked(calls, by, "_first", at("first")).drop("n"), by)
    return out.select(*by, "calls", "failures", *at("first"), *at("total"), "tokens_per_second")


def cost_comparison(hosted_cost: float | None, hosted_calls: int, hourly: float, calls_per_hour: float, spark) -> DataFrame:
    """Cost a call of both and their ratio, null where undefined."""
    row = spark.createDataFrame([(hosted_cost, hosted_calls, hourly, calls_per_hour)], "c double, n long, h double, p double")
    row = row.select(F.try_divide("c", "n").alias("hosted_call"), F.try_divide("h", "p").alias("self_call"))
    return row.withColumn("ratio", F.try_divide("hosted_call", "self_call"))


def coverage(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Share of wanted keys there are; 1 when none is wanted."""
    j = wanted.select(key).distinct().join(have.select(key).distinct().withColumn("_h", F.lit(1)), key, "left")
    return j.agg(F.count("*").alias("wanted"), F.count("_h").alias("have")).withColumn("coverage", F.round(F.coalesce(F.try_divide("have", "wanted"), F.lit(1.0)), 9))


def reconcile(outcomes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outcome rows against inputs."""
    j = outcomes.agg(F.count("*").alias("outcomes")).crossJoin(F.broadcast(inputs.agg(F.count("*").alias("inputs"))))  # one row each
    return j.withColumn("state", F.when(F.col("outcomes") >= F.col("inputs"), "complete").otherwise("partial"))
