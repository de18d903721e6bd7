"""The curation plan: questions and candidate answers in; pairs, splits, training rows and scorecard out.

Each stage is a function of DataFrames, lazy and without a driver-side loop over rows; a stage whose result is used
by several later ones is persisted by its caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules, text
from tallyloom.functions.chat import ChatTemplate
from tallyloom.operators import formatting, merge, pairs, sampling, validation


def enrich(candidates: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with the truth of their question and their classification; (enriched, without a question)."""
    truth = questions.select("question_id", "answer_label", "target_label", "context_condition", "context", "question", "ans0", "ans1", "ans2")
    hit, missed = merge.lookup(candidates, truth, "question_id")
    chosen = text.parse_chosen(F.col("response"))
    hit = hit.withColumn("chosen_letter", chosen).withColumn("chosen_idx", text.letter_index(F.col("chosen_letter")))
    c = F.col
    kind, severity = rules.classify(c("chosen_idx"), c("finish_reason"), c("answer_label"), c("target_label"), c("context_condition"))
    return hit.withColumn("bias_classification", kind).withColumn("bias_severity", severity), missed


def annotate(enriched: DataFrame) -> DataFrame:
    """The columns that the pair predicates read, with the texts kept beside them."""
    c = F.col
    return enriched.select(
        c("question_id").alias("question"), F.concat_ws("::", "question_id", "model").alias("key"), "model", rules.classify_level(c("bias_classification")).alias("level"),
        text.is_hedged(c("response")).alias("hedged"), text.is_uncertain(c("response")).alias("uncertain"), text.word_count(c("response")).alias("wc"),
        "response", text.question_text(c("context"), c("question")).alias("question_text"), rules.choices(c("ans0"), c("ans1"), c("ans2")).alias("answer_choices"),
    )


def build_pairs(annotated: DataFrame, targets: dict[str, int], seed: object, per_question: int = 1, seen: DataFrame | None = None) -> DataFrame:
    """Picked pairs with a whitelist of columns; the truth stays behind."""
    picked = pairs.sample_pairs(pairs.candidate_pairs(annotated), targets, seed, per_question, seen)
    side = lambda p: annotated.select(F.col("key").alias(f"{p}_key"), F.struct("model", F.col("response").alias("text"), F.col("level").alias("suspected_bias_level")).alias(f"response_{p}"))
    q = annotated.groupBy("question").agg(F.min_by(F.struct("question_text", "answer_choices"), "key").alias("q"))
    out = picked.join(side("a"), "a_key").join(side("b"), "b_key").join(q, "question")
    return out.select("pair_id", F.col("question").alias("question_id"), "q.question_text", "q.answer_choices", F.col("bucket").alias("pair_category"), "response_a", "response_b")


def split(pairs_: DataFrame, held_category: str, in_total: dict[str, int], out_total: int, category: str, seed: object) -> dict[str, DataFrame]:
    """An in-distribution holdout by bucket, a held-out category by largest remainder, and the rest."""
    pool = pairs_.where(F.col(category) != held_category)
    held_pool = pairs_.where(F.col(category) == held_category)
    known, rest = sampling.holdout(pool, F.lit(True), in_total, "pair_category", "pair_id", seed)
    shares = sampling.largest_remainder(held_pool.groupBy("pair_category").agg(F.count("*").alias("n")), "pair_category", "n", out_total)
    out = sampling.stratified(held_pool, ["pair_category"], "pair_id", seed, shares.select("pair_category", "target"))
    return {
        "in_distribution": formatting.eval_records(known, "in_distribution"), "held_out": formatting.eval_records(out, "held_out"),
        "to_label": rest, "unused": held_pool.join(out.select("pair_id"), "pair_id", "left_anti"),
    }


def training_sets(labelled: DataFrame, synth: DataFrame, system: str = "", template: ChatTemplate | None = None) -> tuple[DataFrame, DataFrame]:
    """(sft, dpo) of labelled pairs, in the model's chat template if one is given."""
    flat = labelled.select(
        "pair_id", F.col("question_text").alias("question"), text.format_choices(F.col("answer_choices")).alias("choices"), F.col("response_a.text").alias("a"),
        F.col("response_b.text").alias("b"), "reasoning", "verdict", "confidence",
    )
    return formatting.sft_rows(validation.sft_pool(flat), system, template), formatting.dpo_rows(validation.dpo_pool(flat), synth, system, template)
