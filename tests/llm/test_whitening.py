import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, most=8):
    """The same in plain numpy over the rows that are kept."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], object)
    n, d = len(x), len(x[0])
    s = x.sum(0)
    c = np.array([[float((n * a - b)) / n for a, b in zip(r, s)] for r in x])
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, (vec_id, _) in enumerate(rows):
        dev = int(sum((n * a - b) ** 2 for a, b in zip(x[i], s)))
        for k in range(min(most, d)):
            out.setdefault((vec_id, k + 1), []).append((n, dev, float(c[i] @ q[:, k] / math.sqrt(e[k])), float(e[k] / e.sum())))
    return out


def made(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(rng.normal(size=(n, d)) * np.linspace(1, 4, d) + 5)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def test_against_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS", 20)  # several blocks of pairs
    rows = made(300, 10)
    bad = [(1000, None), (1001, [None] + [0.0] * 9), (1002, [float("nan")] + [0.0] * 9), (1003, [float("-inf")] + [0.0] * 9), (1004, []), (1005, [1.0, 2.0])]
    got = whitening.whiten(table(spark, rows + bad).withColumn("vec", F.lit("clash")).withColumn("component", F.lit(9)).withColumn("x0", F.lit(1))).collect()
    expect = plain(rows)
    assert len(got) == 300 * 8
    sign = {}
    for r in got:
        [(n, dev, w, part)] = expect[r["vec_id"], r["component"]]
        sign.setdefault(r["component"], np.sign(w * r["whitened"]))
        assert (r["n"], r["deviation"]) == (n, dev)
        assert math.isclose(r["whitened"], sign[r["component"]] * w, rel_tol=1e-7, abs_tol=1e-8) and math.isclose(r["explained"], part, rel_tol=1e-9)
        assert r["identity_error"] < 1e-9


def test_repeated_rows_and_ids(spark):
    rows = made(40, 3)
    rows += rows[:10] + [(None, rows[0][1]), (None, rows[1][1])]
    got = whitening.whiten(table(spark, rows)).collect()
    expect = plain(rows)
    assert len(got) == len(rows) * 3
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"]) for r in got) == sorted((str(i), k, o[1]) for (i, k), many in expect.items() for o in many)


def test_no_variance(spark):
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in line)


def test_nothing_left(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    got = whitening.whiten(table(spark, [(1, None), (2, []), (3, [float("inf")])]))
    assert got.collect() == [] and [f.name for f in got.schema] == "vec_id component n deviation whitened explained identity_error".split()


def test_huge_entries(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [0.0, 2.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] < 2} == {None}


def test_deviations_are_exact():
    x = np.array([[2**40, 3], [5, -(2**40)], [7, 9]], np.int64)
    s = [int(v) for v in x.sum(0)]
    for n in (3, 10**6):
        exact = [sum((n * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]
        assert whitening.deviations(x, n, s) == [v if v < 2**63 else None for v in exact]
    small = x[2:] * 1000
    assert whitening.deviations(small, 3, [5, 6]) == [(3 * 7000 - 5) ** 2 + (3 * 9000 - 6) ** 2]


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_one_aggregation_without_python(spark, dims):
    """The pairs are summed by built-in functions, with a partial sum in each task."""
    rows = whitening.integers(whitening.vectors(table(spark, made(20, dims)))[0], dims)
    plan = rows.selectExpr("sum(x0 * x0)")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Arrow" not in plan
