"""Training rows, routing of model output, and cross-check assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import hashing, rules, text
from tallyloom.functions.chat import ChatTemplate
from tallyloom.operators.merge import doubled


def _prompt(system: str, user: Column, template: ChatTemplate | None) -> Column:
    """The model's own template, or the plain one where none is given."""
    if template is None:
        return text.apply_chat(F.lit(system), user)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return template.render(F.array(*([message("system", F.lit(system))] if system else []), message("user", user)))


def with_token_lengths(df: DataFrame, columns: list[str], count) -> DataFrame:
    """Lengths of text columns in tokens, as ``<column>_tokens``; ``count`` is ``text.token_length_udf`` of the model's vocabulary."""
    return df.withColumns({f"{c}_tokens": count(F.col(c)) for c in columns})


def sft_rows(df: DataFrame, system: str = "", template: ChatTemplate | None = None) -> DataFrame:
    """Plain and swapped rows (pair_id, swap, prompt, target) of labelled pairs with question, choices (text), a, b, reasoning, verdict."""
    d = doubled(df)
    c = F.col
    user = text.user_message(c("question"), c("choices"), c("a"), c("b"), c("swap"))
    return d.select("pair_id", "swap", _prompt(system, user, template).alias("prompt"), text.make_target(c("reasoning"), c("verdict"), c("swap")).alias("target"))


def dpo_rows(df: DataFrame, synth: DataFrame, system: str = "", template: ChatTemplate | None = None) -> DataFrame:
    """(pair_id, swap, source, prompt, chosen, rejected); the hash bucket picks a synthesised rejection or the flipped verdict.

    Pairs of the synth bucket without a synthesised row drop out (count them with A47).
    """
    c = F.col
    s = synth.select("pair_id", c("reasoning").alias("s_reasoning"), c("verdict").alias("s_verdict"))
    d = df.join(s, "pair_id", "left").withColumn("source", F.when(hashing.is_synth(c("pair_id").cast("string")), "synth").otherwise("flip"))
    d = doubled(d.where("source = 'flip' or s_verdict is not null"))
    user = text.user_message(c("question"), c("choices"), c("a"), c("b"), c("swap"))
    flipped = text.make_target(c("reasoning"), text.flip_verdict(c("verdict")), c("swap"))
    made = text.make_target(F.coalesce("s_reasoning", F.lit("")), F.coalesce("s_verdict", F.lit("TIE")), c("swap"))
    return d.select(
        "pair_id", "swap", "source", _prompt(system, user, template).alias("prompt"),
        text.make_target(c("reasoning"), c("verdict"), c("swap")).alias("chosen"), F.when(c("source") == "synth", made).otherwise(flipped).alias("rejected"),
    )


def routed(df: DataFrame, output: str, status: str, stop: str, known: Column) -> DataFrame:
    """K8: parsed fields and a route: unknown_key, batch_error, refusal, parse_error or ok; writing by route is one partitioned write."""
    p = text.parse_tagged(F.col(output))
    d = df.withColumn("parsed", p)
    route = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown_key").when(F.col(status) != "succeeded", "batch_error").when(F.col("parsed.error").isNull(), "ok")
        .when(text.detect_refusal(F.col(output), F.col(stop)), "refusal").otherwise("parse_error")
    )
    return d.withColumn("route", route)


def routed_synth(df: DataFrame, output: str, status: str, expected: Column) -> DataFrame:
    """K9: batch_error, parse_error (with its reason) or ok of synthesised targets; one partitioned write stores all routes."""
    d = df.withColumn("checked", text.validate_synth(F.col(output), expected))
    route = F.when(F.col(status) != "succeeded", "batch_error").when(F.col("checked.ok"), "ok").otherwise("parse_error")
    return d.withColumn("route", route).withColumn("reason", F.when(route == "parse_error", F.col("checked.reason"))).drop("checked")


def cross_checked(base: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two optional verdicts beside the label, with the disagreement of those there are."""
    a = first.select(key, F.col("verdict").alias("verdict_b"))
    b = second.select(key, F.col("verdict").alias("verdict_c"))
    j = base.join(a, key, "left").join(b, key, "left")
    return j.withColumn("disagreement", rules.disagreement([F.col("verdict"), F.col("verdict_b"), F.col("verdict_c")]))


def eval_records(df: DataFrame, slice_name: str) -> DataFrame:
    """Without the suspected level, with label stubs and the slice."""
    out = df
    for side in ("response_a", "response_b"):
        out = out.withColumn(side, F.col(side).dropFields("suspected_bias_level"))
    return out.withColumns({"human_verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("int"), "notes": F.lit(None).cast("string"), "eval_slice": F.lit(slice_name)})


def with_stubs(df: DataFrame, stubs: dict[str, str]) -> DataFrame:
    """Null columns of the given types where they are absent."""
    return df.withColumns({k: F.lit(None).cast(t) for k, t in stubs.items() if k not in df.columns})


#: A pass is (temperature, swapped, run); the table is the bijection.
PASSES = [("original", 0.0, False, 0), ("swapped", 0.0, True, 0), *[(f"consistency_{i}", 0.3, False, i) for i in range(5)]]


def pass_spec(spark) -> DataFrame:
    return spark.createDataFrame(PASSES, "pass string, temperature double, swapped boolean, run_index int")


def with_pass(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions with their pass, rows of an unknown combination)."""
    spec = F.broadcast(pass_spec(predictions.sparkSession))
    on = ["temperature", "swapped", "run_index"]
    return predictions.join(spec, on), predictions.join(spec, on, "left_anti")
