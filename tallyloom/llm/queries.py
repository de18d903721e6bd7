"""The corpus operators' registered queries, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decision_list, mixing, near_dedup, secrets, url_filter
from tallyloom.llm.collocations import oracle as phrase_oracle
from tallyloom.llm.common import load


def op1_mix_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return decision_list.judge(docs, decision_list.learn(docs, load(spark, sf_dir, "labels")))


def op3_html_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.html_text import main_text

    return main_text(load(spark, sf_dir, "pages"))


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import nbsvm

    docs = load(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, load(spark, sf_dir, "labels")))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), k=3, percent=85)


def op6_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.digest import fingerprints

    return fingerprints(load(spark, sf_dir, "documents"))


def op7_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"), url_filter.RULES)


def op8_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(load(spark, sf_dir, "documents"))


def op9_toxicity_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import toxicity

    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.bpe import encode_documents

    return encode_documents(load(spark, sf_dir, "documents"))


def op11_whiten_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.whitening import whiten

    return whiten(load(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.token_counts import count_tokens

    return count_tokens(load(spark, sf_dir, "documents"))


def op13_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.collocations import collocations

    return collocations(load(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_pareto,
        op2_decision_list,
        op3_html_boosted_dom,
        op4_quality_nbsvm,
        op5_minhash_near_dedup,
        op6_improbable_digest,
        op7_url_redirects,
        op8_secret_trigrams,
        op9_toxicity_levenshtein,
        op10_bpe_tree,
        op11_whiten_triangle,
        op12_token_counts,
        op13_suffix_sigma,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_pareto": mixing.ORACLE,
    "op5_minhash_near_dedup": near_dedup.oracle(3, 85),
    "op7_url_redirects": url_filter.ORACLE,
    "op8_secret_trigrams": secrets.oracle(),
    "op13_suffix_sigma": phrase_oracle(),
}
