"""The pipeline's stages as functions of documents; each returns the columns of its input unless stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, nbsvm, secrets
from tallyloom.llm.bpe import encode_documents
from tallyloom.llm.common import discard, load, materialize
from tallyloom.llm.idfilter import may_hold
from tallyloom.llm.near_dedup import near_duplicates


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def aside(docs: DataFrame, prefixes: tuple[str, ...], work) -> DataFrame:
    """``work(docs)`` with the columns whose names an operator keeps for itself renamed meanwhile."""
    other = {c: fresh(docs, f"kept_{i}") for i, c in enumerate(docs.columns) if c.lower().startswith(prefixes)}
    out = work(docs.withColumnsRenamed(other))
    return out.withColumnsRenamed({v: k for k, v in other.items()}).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under its threshold go.

    Null and empty texts are scored by the model's bias; equal rows are judged alike; an empty table stays empty.
    """
    return nbsvm.score(docs, nbsvm.train(docs, load(spark, sf_dir, "labels")), keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8): the one of smallest id (nulls last),
    of equal ids the one whose text has the smallest hash, of equal texts the first row.

    Each row is a document, whatever its id: rows that share an id or have none are judged by their texts, and of equal rows
    one stays (of those without words, too, if their ids are equal). Only rows that may go (a filter of bounded size tells
    the others) are moved.
    """
    row, mark = fresh(docs, "row"), fresh(docs, "mark")
    # Numbered once in a written table, so a repeated task can't number anew.
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(mark, F.xxhash64("text")), "numbered")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("n"), "n_shingles", "component_id")
    named = rows.select(F.col(row).alias("n"), F.col("doc_id").alias("id"), F.col(mark).alias("mark")).join(found.hint("shuffle_hash"), "n")
    # Rows without words link with nothing; those of one id are repetitions.
    blank = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    group = F.struct(blank.alias("blank"), F.when(blank, F.col("id")).otherwise(F.col("component_id")).alias("of"))
    named = materialize(named.select("n", "id", "mark", group.alias("g")), "groups")
    # One row a group by a map-side minimum, then a join on the row's number: a large group is never one key.
    stay = named.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "n"))["n"].alias("n")).select("n")
    gone = materialize(named.select("n").join(stay.hint("shuffle_hash"), "n", "left_anti"), "gone")
    discard(named)
    may = may_hold(gone, "n", F.col(row))
    left = rows.where(may).join(gone.hint("shuffle_hash"), F.col(row) == F.col("n"), "left_anti")
    return left.unionByName(rows.where(~may)).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. Null and empty texts stay as they are."""
    return aside(docs, ("secret_",), _redacted)


def _redacted(docs: DataFrame) -> DataFrame:
    s = secrets.scan(docs)
    found = F.size("secret_spans") > 0
    text = secrets.redacted(F.col("text"), F.col("secret_spans"))
    s = s.withColumn("secret_text", text)
    if "n_chars" in docs.columns:
        s = s.withColumn("n_chars", F.when(found, F.length("secret_text").cast("long")).otherwise(F.col("n_chars")))
    return s.withColumn("text", F.col("secret_text")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks for.

    A null source is a source; one without words has target 0 and goes; of equal rows as many stay as fit; an empty table stays empty.
    """
    return aside(docs, ("mix_", "cut_"), lambda d: mixing.repeated(mixing.mix(d), d.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each copy; null and empty texts have no ids."""
    return encode_documents(docs, with_ids=True)
