"""Embedding whitening: covariance by upper-triangle column aggregates, components by LAPACK.

1. One aggregation counts the vectors and sums each dimension (long integers, exact).
2. Spark SQL expressions, one a pair of dimensions i <= j, sum the centred products (x_i - S_i / n) * (x_j - S_j / n)
   in one aggregation; tasks send one row of sums each. Vectors of more than ``PAIRS`` pairs (90 dimensions) take one
   aggregation a block of pairs, since a plan can't hold any number of expressions.
3. The driver assembles the covariance (dimensions squared, whatever the rows) and decomposes it (``eigh``).
4. Tasks project their rows; the covariance of the result is taken in the same way as the first.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry go, as do those that haven't the commonest length
(of equally common ones the longest), since they have other dimensions; empty vectors and empty tables give no rows. Entries
beyond 2**30 in size are taken as 2**30, so that integers fit. ``deviation`` is null where it needs more than 63 bits. A component without
variance (an eigenvalue within rounding of zero, as of one row or of equal rows) has a null ``whitened`` and counts in no
identity error; without any such component ``identity_error`` is null. Ties of vectors and repeated rows or ids are kept row by row;
further columns are ignored. The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, tidy

PAIRS = 4_096
LARGEST = 2**30
SCALE, OFFSET = 1024, 100_000
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _usable(vector: Column) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)


def vectors(table: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vec: doubles) of the rows that are kept, and their number of dimensions (0 without rows)."""
    kept = table.select("vec_id", F.col(column).cast("array<double>").alias("vec")).where(_usable(F.col("vec")))
    common = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = common["d"] if common else 0
    return kept.where(F.size("vec") == dims), dims


def covariance(rows: DataFrame, columns: list[str], means: list[float], n: int) -> np.ndarray:
    """The covariance (divisor n) of numeric columns around the given means."""
    centred = rows.selectExpr(*[f"`{c}` - {m!r}D as d{i}" for i, (c, m) in enumerate(zip(columns, means))])
    out = np.zeros((len(columns), len(columns)))
    pairs = combinations_with_replacement(range(len(columns)), 2)
    while block := list(islice(pairs, PAIRS)):
        sums = centred.selectExpr(*[f"sum(d{i} * d{j}) as s{i}_{j}" for i, j in block]).first()
        for (i, j), s in zip(block, sums):
            out[i, j] = out[j, i] = s / n
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # a row each
    eigenvalues: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Whether a component has variance, beyond what rounding leaves."""
        e = self.eigenvalues
        return e > max(float(e[0]), 0.0) * len(self.sums) * 1e-14 if len(e) else np.zeros(0, bool)


def integers(vec: DataFrame, dims: int) -> DataFrame:
    """x0, x1, ...: the entries as long integers."""
    entry = lambda i: f"greatest(least(vec[{i}], {LARGEST}D), -{LARGEST}D)"
    return vec.selectExpr(*[f"floor({SCALE}D * {entry(i)}) + {OFFSET}L as x{i}" for i in range(dims)])


def fit(vec: DataFrame, dims: int, most: int = 8) -> Whitening:
    x = integers(vec, dims)
    n, *sums = x.selectExpr("count(1) as n", *[f"sum(x{i}) as s{i}" for i in range(dims)]).first()
    v = covariance(x, [f"x{i}" for i in range(dims)], [s / n for s in sums], n)
    e, columns = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    components = columns[:, order].T
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])
    return Whitening(n, [int(s) for s in sums], components * signs[:, None], e[order], float(np.trace(v)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n * x - S) squared of each row, in integers of any size; None beyond 63 bits."""
    if not len(x):
        return []
    far = n * int(np.abs(x).max()) + max(map(abs, sums))
    if far < 2**62:
        t = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(t).max()) ** 2 < 2**63:
            return (t * t).sum(1).tolist()
    t = n * x.astype(object) - np.array(sums, object)
    return [s if s < 2**63 else None for s in (t * t).sum(1).tolist()]


def project(vec: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, and w0, w1, ...: the whitened components that have variance."""
    mean = np.array([s / model.n for s in model.sums])
    live = model.live
    onto = (model.components[live] / np.sqrt(model.eigenvalues[live])[:, None]).T
    n, sums, dims = model.n, model.sums, len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64) + OFFSET
            w = (x - mean) @ onto
            columns = [batch.column("vec_id").cast(pa.int64()), pa.array(deviations(x, n, sums), pa.int64()), *[pa.array(w[:, k]) for k in range(w.shape[1])]]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", *[f"w{k}" for k in range(w.shape[1])]])

    names = [f"w{k} double" for k in range(onto.shape[1])]
    return vec.mapInArrow(tidy(run), ", ".join(["vec_id long", "deviation long", *names]))


def whiten(table: DataFrame, column: str = "embedding", most: int = 8) -> DataFrame:
    """A row per kept vector and component (``SCHEMA``); ``most`` components at most."""
    vec, dims = vectors(table, column)
    if not dims:
        return table.sparkSession.createDataFrame([], SCHEMA)
    model = fit(vec, dims, most)
    done = materialize(project(vec, model), "whitened")
    names = [c for c in done.columns if c not in ("vec_id", "deviation")]
    error = None
    if names:
        means = list(done.agg(*[F.avg(c) for c in names]).first())
        error = float(np.abs(covariance(done, names, means, model.n) - np.eye(len(names))).max())
    explained = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(len(model.eigenvalues))
    number = iter(names)
    each = [
        F.struct(
            F.lit(k + 1).alias("component"),
            (F.col(next(number)) if live else F.lit(None).cast("double")).alias("whitened"),
            F.lit(max(float(e), 0.0)).alias("explained"),
        )
        for k, (live, e) in enumerate(zip(model.live, explained))
    ]
    rows = done.select("vec_id", "deviation", F.explode(F.array(*each)).alias("c"))
    return rows.select(
        "vec_id",
        "c.component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "c.whitened",
        "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
