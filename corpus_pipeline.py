"""The corpus pipeline: STAGES, run and ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import stages
from tallyloom.llm.common import discard, load, materialize

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("MinHash near-dedup", stages.drop_near_copies),
    ("secret scans", stages.redact_secrets),
    ("mixing sources", stages.mix_sources),
    ("byte-level BPE", stages.tokenize),
]

#: The classifier, the hash tables and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's input goes once its output is written."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)
    return docs
