"""Checks that return the offending rows, or fail the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unknown_values(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """P10: values outside an enumeration, with counts; null counts as unknown."""
    return df.where(~F.coalesce(F.col(column).isin(*known), F.lit(False))).groupBy(column).agg(F.count("*").alias("n"))


def missing_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """Nulls by required column; an absent column misses all its values."""
    cols = [(F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(c) for c in required]
    return df.agg(*cols).unpivot([], required, "column", "missing")


def outside(df: DataFrame, column: str, values: list) -> DataFrame:
    """P12."""
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def unnormalised(df: DataFrame, column: str) -> DataFrame:
    """Values that are not trimmed lower case."""
    return df.where(F.col(column) != F.lower(F.trim(column)))


def split_report(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of the whole, of each part, keys in two parts or more, keys in none."""
    tagged = None
    for name, part in parts.items():
        one = part.select(key, F.lit(name).alias("_part")).distinct()
        tagged = one if tagged is None else tagged.unionByName(one)
    n = tagged.groupBy(key).agg(F.count("*").alias("_n"))
    j = whole.select(key).distinct().join(n, key, "full")
    return j.agg(F.count("*").alias("keys"), F.count_if(F.col("_n") > 1).alias("overlapping"), F.count_if(F.col("_n").isNull()).alias("unassigned"))


def forbidden(df: DataFrame, token: str) -> DataFrame:
    """Rows with the token in any string column."""
    test = F.lit(False)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            test = test | F.coalesce(F.contains(F.col(f.name), F.lit(token)), F.lit(False))
    return df.where(test)


def count_between(df: DataFrame, low: int, high: int) -> DataFrame:
    """P16."""
    return df.agg(F.count("*").alias("n")).withColumn("ok", F.col("n").between(low, high))


def demand(df: DataFrame, test: Column, message: str) -> DataFrame:
    """Rows pass through; the first that fails the test fails the query."""
    ok = F.coalesce(test, F.lit(False))
    first = df.columns[0]
    return df.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[first].dataType)))


def dpo_pool(df: DataFrame, least: int = 4) -> DataFrame:
    """Confident and not a tie; a missing verdict passes."""
    return df.where((F.col("confidence") >= least) & ~F.col("verdict").eqNullSafe(F.lit("TIE")))


def sft_pool(df: DataFrame, least: int = 3) -> DataFrame:
    """P6."""
    return df.where(F.col("confidence") >= least)


def subset(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """P20: (rows of the keys, keys without a row)."""
    k = keys.select(key).distinct()
    return df.join(k, key, "left_semi"), k.join(df, key, "left_anti")


def required_subset(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """P20: the rows of the keys; keys without a row fail the query."""
    found, missing = subset(df, keys, key)
    n = missing.count()
    if n:
        raise KeyError(f"{n} keys without a row, such as {missing.orderBy(key).first()[0]!r}")
    return found


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """P11 on types: the declared columns in order; a missing or different one is an error at once."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {f.dataType.simpleString()}, found {have[f.name].simpleString() if f.name in have else 'none'}" for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*[f.name for f in schema.fields])
