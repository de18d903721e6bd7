"""Shared pieces: table loading, durable intermediates, words, label folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.package import ship_package
from tallyloom.sources.scratch import discard, materialize, shared_folder  # noqa: F401  (for the operators)

#: A word is a run of anything but ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy(run):
    """``run`` over the batches of a task; then the memory that it used goes back, since workers stay for later tasks."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of documents; sessions with the default size of Arrow batches (10,000 rows of text) get smaller ones."""
    ship_package(spark)
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: a lambda's variable is never replaced by its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal id modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0).cast("long"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled documents outside the held-out fold.

    Documents are taken in order of a hash of the id, so the sample is the same in every run.
    Conflicting labels of one id resolve to the larger, texts of one id to the last in order; null labels and ids
    and labels without a document are skipped. ``most`` bounds the broadcast side: two numbers a row.
    """
    known = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .where(fold(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.max(F.col(target).cast("int")).alias("y"))
    )
    # Labels grow with the corpus: they are cut to the quota by the ids that documents have, before any text moves.
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("doc_id", "y", "text")


def sigmoid_fit(x, y, rounds: int = 100):
    """Newton's method for P(y = 1) = 1 / (1 + exp(-(a x + b))), with targets smoothed by Laplace's rule."""
    import numpy as np

    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-6 * a, (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)
