"""Gates: one aggregate row -> (gate, decision, reason)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gate(df: DataFrame, name: str, decision: Column, reason: Column) -> DataFrame:
    return df.select(F.lit(name).alias("gate"), decision.alias("decision"), reason.alias("reason"))


def generation(df: DataFrame, least_parsed: float = 0.5, least_match: float = 0.1) -> DataFrame:
    """G1 over (total, failed, matches): exit code 0, 4 or 5 with its message; no rows is 5."""
    parsed = F.col("total") - F.col("failed")
    rate = F.coalesce(F.try_divide("matches", parsed), F.lit(0.0))
    code = F.when((F.col("total") == 0) | (parsed < least_parsed * F.col("total")), 5).when(rate < least_match, 4).otherwise(0)
    reason = F.when(F.col("total") == 0, "no rows").when(code == 5, "parse rate too low").when(code == 4, "match rate too low").otherwise("pass")
    return _gate(df, "generation", code, reason)


def labeler(df: DataFrame, overall: int = 46, hard: int = 24, abort: int = 22) -> DataFrame:
    """G2 over (overall, hard)."""
    decision = F.when(F.col("hard") < abort, "ABORT").when((F.col("overall") >= overall) & (F.col("hard") >= hard), "PROCEED").otherwise("REVIEW")
    return _gate(df, "labeler", decision, F.format_string(f"overall %d (need {overall}), hard %d (need {hard}, abort under {abort})", F.col("overall").cast("long"), F.col("hard").cast("long")))


def shortfalls(df: DataFrame, most: float = 0.1) -> DataFrame:
    """G3 over (bucket, target, achieved): buckets that miss more than a share of their target."""
    share = 1 - F.col("achieved") / F.col("target")
    return df.where((F.col("target") > 0) & (share > most)).select("bucket", "target", "achieved", F.round(share, 9).alias("shortfall"))


def at_most(df: DataFrame, name: str, value: str, limit: float, empty: str = "PASS", otherwise: str = "FAIL") -> DataFrame:
    """Value <= limit; ``empty`` where there is no value."""
    decision = F.when(F.col(value).isNull(), empty).when(F.col(value) <= limit, "PASS").otherwise(otherwise)
    return _gate(df, name, decision, F.concat(F.lit(f"{value} "), F.coalesce(F.round(F.col(value).cast("double"), 6).cast("string"), F.lit("undefined")), F.lit(f", at most {limit}")))


def at_least(df: DataFrame, name: str, value: str, limit: float) -> DataFrame:
    """G8."""
    return _gate(df, name, F.when(F.col(value) >= limit, "PASS").otherwise("FAIL"), F.concat(F.lit(f"{value} "), F.round(F.col(value).cast("double"), 6).cast("string"), F.lit(f", at least {limit}")))


def length_gates(df: DataFrame) -> DataFrame:
    """G7 over (median_ratio, p90_ratio, divergence): the first blocks, the others warn."""
    parts = [at_most(df, "median_ratio", "median_ratio", 1.15, otherwise="BLOCK"), at_most(df, "p90_ratio", "p90_ratio", 1.2, otherwise="WARN"), at_most(df, "divergence", "divergence", 1.25, otherwise="WARN")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def budget(df: DataFrame, cap: float, override: bool = False) -> DataFrame:
    """G9 over (spent, projected)."""
    after = F.coalesce("spent", F.lit(0.0)) + F.col("projected")
    decision = F.when(after <= cap, "PROCEED").otherwise("OVERRIDE" if override else "STOP")
    return _gate(df, "budget", decision, F.format_string(f"%.6f of {cap:.6f}", after))


def overcollapse(log: DataFrame, by: list[str], step: str) -> DataFrame:
    """G10/W12 over (margin, accuracy, chosen, rejected) by step: later half against its start, ordered rules.

    A training log is small a run; runs are the groups.
    """
    ok = log.where("margin is not null and chosen is not null")
    w = Window.partitionBy(*by).orderBy(step)
    all_ = Window.partitionBy(*by)
    r = ok.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(all_))
    mid = F.when(F.floor(F.col("_n") / 2) >= F.col("_n") - 1, F.greatest(F.col("_n") - 2, F.lit(0))).otherwise(F.floor(F.col("_n") / 2))
    at = lambda c, i: F.max(F.when(F.col("_i") == i, F.col(c)))
    g = r.withColumn("_mid", mid).groupBy(*by).agg(
        F.max("_n").alias("n_points"),
        *[(at(c, F.col("_n") - 1) - at(c, F.col("_mid"))).alias(f"{c}_delta") for c in ("margin", "chosen", "rejected")],
        at("accuracy", F.col("_n") - 1).alias("final_accuracy"),
    )
    m, c, j, a = (F.col(x) for x in ("margin_delta", "chosen_delta", "rejected_delta", "final_accuracy"))
    verdict = (
        F.when(F.col("n_points") < 2, "INSUFFICIENT_DATA").when(F.coalesce(a < 0.5, F.lit(False)) | (m <= 0.1), "ABORT").when((c < -3) & (j < -3) & (m < 0.5), "ABORT")
        .when((m > 0.5) & (a >= 0.55), "OK").otherwise("WARN")
    )
    return g.select(*by, "n_points", *[F.round(x, 9).alias(n) for x, n in ((m, "margin_delta"), (c, "chosen_delta"), (j, "rejected_delta"), (a, "final_accuracy"))], verdict.alias("verdict"))


def phase(df: DataFrame) -> DataFrame:
    """G11 over (prior_status, prompt_hash, expected_hash): the prior phase is complete and the prompt unchanged."""
    decision = F.when(~F.col("prior_status").eqNullSafe(F.lit("complete")), "STOP").when(~F.col("prompt_hash").eqNullSafe(F.col("expected_hash")), "STOP").otherwise("PROCEED")
    reason = F.when(~F.col("prior_status").eqNullSafe(F.lit("complete")), "prior phase incomplete").when(decision == "STOP", "prompt changed").otherwise("ready")
    return _gate(df, "phase", decision, reason)


def mask_sanity(df: DataFrame, labels: str) -> DataFrame:
    """Every row of labels has masked (-100) and unmasked places."""
    masked, total = F.size(F.filter(labels, lambda x: x == -100)), F.size(labels)
    bad = (masked == 0) | (masked == total)
    return df.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n")).select(F.lit("mask").alias("gate"), F.when((F.col("bad") == 0) & (F.col("n") > 0), "PASS").otherwise("FAIL").alias("decision"), F.format_string("%d of %d rows", "bad", "n").alias("reason"))


def dry_run_complete(meta: DataFrame, size: int, tolerance: float) -> DataFrame:
    """G12 over (n_records, ratio), a row or none: the dry run is there, whole, and within its length gate."""
    one = meta.agg(F.count("*").alias("rows"), F.max("n_records").alias("n"), F.max("ratio").alias("r"))
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0.0))
    reason = F.when(F.col("rows") == 0, "no dry run").when(n != size, F.format_string("%d of %d records", n, F.lit(size))).when(r > tolerance, "length gate failed").otherwise("complete")
    return one.select(F.lit("dry_run").alias("gate"), F.when(reason == "complete", "PROCEED").otherwise("STOP").alias("decision"), reason.alias("reason"))


def artifacts(present: DataFrame, wanted: DataFrame, floor: int) -> DataFrame:
    """G14 over file tables (name, bytes) and (name): missing and undersized files."""
    j = wanted.join(present, "name", "left")
    return j.select("name", F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") < floor, "too small").otherwise("ok").alias("state"))
