"""Agreement and bias metrics as one-pass aggregations; undefined is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import PARSE_FAIL, VERDICTS


def kappa(human: Column, model: Column, labels: tuple[str, ...] = VERDICTS) -> Column:
    """A10: Cohen's kappa as an aggregate over rows that both judged; failures and misses don't count."""
    ok = human.isin(*labels) & model.isin(*labels)
    share = lambda c: F.avg(F.when(ok, c.cast("int")))
    seen = share(human == model)
    chance = F.lit(0.0)
    for v in labels:
        chance = chance + share(human == v) * share(model == v)
    return F.try_divide(seen - chance, 1 - chance)


def kappa_by(df: DataFrame, by: list[str], human: str = "human", model: str = "model") -> DataFrame:
    """Kappa and the pairs it rests on, by group (none: one row)."""
    ok = F.col(human).isin(*VERDICTS) & F.col(model).isin(*VERDICTS)
    return df.groupBy(*by).agg(F.round(kappa(F.col(human), F.col(model)), 9).alias("kappa"), F.count_if(ok).alias("n"))


def flip(v: Column) -> Column:
    return F.when(v == "A", "B").when(v == "B", "A").when(v == "TIE", "TIE")


def position_bias(df: DataFrame, by: list[str], plain: str = "plain", swapped: str = "swapped") -> DataFrame:
    """Share of pairs whose swapped verdict is not the flipped plain one; failures leave the denominator."""
    ok = F.col(plain).isin(*VERDICTS) & F.col(swapped).isin(*VERDICTS)
    moved = ok & (flip(F.col(plain)) != F.col(swapped))
    return df.groupBy(*by).agg(F.round(F.try_divide(F.count_if(moved), F.count_if(ok)), 9).alias("position_bias"), F.count_if(ok).alias("n"))


def verbosity_bias(df: DataFrame, by: list[str], verdict: str, len_a: str, len_b: str) -> DataFrame:
    """Mean length of the chosen minus the rejected response over decided pairs."""
    d = F.when(F.col(verdict) == "A", F.col(len_a) - F.col(len_b)).when(F.col(verdict) == "B", F.col(len_b) - F.col(len_a))
    return df.groupBy(*by).agg(F.round(F.avg(d), 9).alias("verbosity_bias"), F.count(d).alias("n"))


def self_consistency(runs: DataFrame, by: list[str], key: str, verdict: str, k: int) -> DataFrame:
    """Share of keys with one verdict over k runs; a failure or a missing run excludes the key."""
    if k < 2:
        raise ValueError("self-consistency needs two runs or more")
    each = runs.groupBy(*by, key).agg(F.count("*").alias("_n"), F.count_if(~F.col(verdict).isin(*VERDICTS) | F.col(verdict).isNull()).alias("_bad"), F.count_distinct(verdict).alias("_d"))
    ok = (F.col("_n") >= k) & (F.col("_bad") == 0)
    return each.groupBy(*by).agg(F.round(F.try_divide(F.count_if(ok & (F.col("_d") == 1)), F.count_if(ok)), 9).alias("self_consistency"), F.count_if(ok).alias("n"))


def failure_rate(df: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """A16."""
    return df.groupBy(*by).agg(F.round(F.avg((F.col(verdict) == PARSE_FAIL).cast("int")), 9).alias("failure_rate"), F.count("*").alias("n"))


def scorecard(wide: DataFrame, sampled: DataFrame, model: str, k: int) -> DataFrame:
    """(model, metric, value). ``wide``: a row a (model, pair) with human, slice, category, plain, swapped, len_a, len_b;
    ``sampled``: a row a (model, pair, run) with verdict. Two passes over the data, whatever the number of models."""
    h, m = F.col("human"), F.col("plain")
    on = lambda c, t: F.when(t, c)  # noqa: E731  other rows become null, which kappa skips
    ind, out = F.col("slice") == "in_distribution", F.col("slice") != "in_distribution"
    ok = m.isin(*VERDICTS) & F.col("swapped").isin(*VERDICTS)
    moved = ok & (flip(m) != F.col("swapped"))
    bias = lambda t: F.try_divide(F.count_if(moved & t), F.count_if(ok & t))
    d = F.when(m == "A", F.col("len_a") - F.col("len_b")).when(m == "B", F.col("len_b") - F.col("len_a"))
    named = {
        "kappa_in_distribution": kappa(on(h, ind), m), "kappa_held_out": kappa(on(h, out), m),
        **{f"kappa_{c}": kappa(on(h, ind & (F.col("category") == c)), m) for c in ("clear", "subtle", "tracked", "tie")},
        "position_bias_in_distribution": bias(ind), "position_bias_held_out": bias(out), "verbosity_bias": F.avg(d),
    }
    failed = lambda c: F.count_if(F.col(c) == PARSE_FAIL)
    one = wide.groupBy(model).agg(*[v.alias(n) for n, v in named.items()], (failed("plain") + failed("swapped")).alias("_bad"), (F.count("plain") + F.count("swapped")).alias("_all"))
    two = sampled.groupBy(model).agg(F.count_if(F.col("verdict") == PARSE_FAIL).alias("_bad2"), F.count("*").alias("_all2"))
    same = self_consistency(sampled, [model], "pair", "verdict", k).select(model, "self_consistency")
    row = one.join(two, model, "left").join(same, model, "left")
    row = row.withColumn("parse_failure", F.try_divide(F.col("_bad") + F.coalesce("_bad2", F.lit(0)), F.col("_all") + F.coalesce("_all2", F.lit(0))))
    metrics = [*named, "self_consistency", "parse_failure"]
    return row.select(model, *[F.round(F.col(x), 9).alias(x) for x in metrics]).unpivot(model, metrics, "metric", "value")


def agreement(df: DataFrame, group: str, hard: list[str], a: str, b: str) -> DataFrame:
    """A2: (grain, matches, total, rate) overall, for the hard groups and by group, in one grouping-sets pass; an empty rate is 0."""
    same = F.col(a).eqNullSafe(F.col(b))
    base = df.select(F.col(group).alias("g"), same.alias("s")).groupBy("g").agg(F.count_if("s").alias("m"), F.count("*").alias("n"))
    rows = base.select(F.explode(F.array(F.lit("overall"), F.concat(F.lit("group:"), F.col("g")), F.when(F.col("g").isin(*hard), "hard"))).alias("grain"), "m", "n").where("grain is not null")
    return rows.groupBy("grain").agg(F.sum("m").alias("matches"), F.sum("n").alias("total")).withColumn("rate", F.round(F.coalesce(F.try_divide("matches", "total"), F.lit(0.0)), 9))


def histogram(df: DataFrame, column: str, values: list, by: list[str] | None = None) -> DataFrame:
    """Counts of an enumeration's values, zero-filled, nulls and others skipped: (by.., value, n)."""
    by = by or []
    got = df.groupBy(*by).agg(*[F.count_if(F.col(column).cast("string") == str(v)).alias(f"v{i}") for i, v in enumerate(values)])
    pairs = F.explode(F.array(*[F.struct(F.lit(str(v)).alias("value"), F.col(f"v{i}").alias("n")) for i, v in enumerate(values)])).alias("x")
    return got.select(*by, pairs).select(*by, "x.value", "x.n")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A1: counts with row totals, and an ``all`` row."""
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.rollup(row).agg(*cells, F.count("*").alias("total"), F.grouping(row).alias("_g")).withColumn(row, F.when(F.col("_g") == 1, "all").otherwise(F.col(row))).drop("_g")
