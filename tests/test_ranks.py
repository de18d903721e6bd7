"""Ranks, percentiles and pair pools of large groups."""

import math
import random

from pyspark.sql import functions as F

from tallyloom.operators import pairs, ranks

PLACES = {"low": ranks.nearest(0.0), "mid": ranks.nearest(0.5), "most": ranks.trunc(0.99), "a": ranks.below(0.9), "b": ranks.above(0.9)}


def at(values, name):
    n = len(values)
    i = {"low": 0, "mid": round(0.5 * (n - 1)), "most": min(math.floor(0.99 * n), n - 1), "a": math.floor(0.9 * (n - 1)), "b": math.ceil(0.9 * (n - 1))}[name]
    return sorted(values, key=lambda v: (v != v, v))[i]


def same(a, b):
    return a == b or a != a and b != b


def test_ranks_of_all_kinds_of_groups(spark):
    """Rounds of histograms (groups of more than 20 values) against sorting."""
    rnd = random.Random(4)
    groups = {
        "uniform": [rnd.random() for _ in range(800)], "equal": [3.5] * 300, "powers": [2.0**rnd.randrange(-300, 300) for _ in range(500)], "few": [1.0, 2.0],
        "near": [1e9 + rnd.randrange(90) * 1e-7 for _ in range(400)], "signed": [rnd.choice([-1, 1]) * rnd.expovariate(1) ** 9 for _ in range(600)],
        "odd": [float("inf"), float("-inf"), 1.7e308, -1.7e308, 0.0, float("nan")] * 20 + [rnd.random() for _ in range(99)], "one": [7.0], None: [5.0, 1.0, 3.0] * 30, "none": [],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("uniform", None), ("one", None)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g string, x double").repartition(4)
    got = {r["g"]: r for r in ranks.ranked(df, ["g"], "x", PLACES, small=20, also=[F.count("*").alias("rows")]).collect()}
    assert set(got) == set(groups) and got["one"]["rows"] == 2
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for k in PLACES:
            assert (got[g][k] is None) if not values else same(got[g][k], at(values, k)), (g, k)


def test_integers_and_whole_tables(spark):
    rnd = random.Random(5)
    values = [rnd.randrange(-(2**62), 2**62) for _ in range(300)] + [2**53 + i for i in range(100)] + [2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    r = ranks.ranked(df, [], "x", PLACES, small=10).first()
    assert [r[k] for k in PLACES] == [at(values, k) for k in PLACES]
    empty = ranks.ranked(df.limit(0), [], "x", PLACES).collect()
    assert [tuple(r) for r in empty] == [(0, *[None] * len(PLACES))]
    assert ranks.ranked(df.withColumn("g", F.lit(1)).limit(0), ["g"], "x", PLACES).collect() == []


def test_percentiles_equal_the_built_in_ones(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(rnd.choice("ab"), rnd.gauss(0, 9)) for _ in range(701)], "g string, x double")
    mine = {r["g"]: (r["m"], r["p"]) for r in ranks.percentiles(df, ["g"], "x", {"m": 0.5, "p": 0.9}, small=15).collect()}
    theirs = {r["g"]: (r["m"], r["p"]) for r in df.groupBy("g").agg(F.median("x").alias("m"), F.percentile("x", F.lit(0.9)).alias("p")).collect()}
    assert mine == theirs


def test_a_million_values_in_one_group_are_not_gathered(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).cast("double").alias("x"))
    r = ranks.ranked(df, ["g"], "x", {"mid": ranks.nearest(0.5), "most": ranks.trunc(0.99)}, small=1000)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    values = sorted(i * 7919 % 1_000_003 for i in range(1_000_000))
    assert [r.first()["mid"], r.first()["most"]] == [values[round(0.5 * 999_999)], values[990_000]]


CANDS = "question long, key string, model long, level string, hedged boolean, uncertain boolean, wc double"


def made(n, seed, question=1):
    rnd = random.Random(seed)
    level = lambda: rnd.choice(["biased", "neutral", "unclear", "excluded", None])
    maybe = lambda v: None if rnd.random() < 0.05 else v
    return [(question, maybe(f"k{i}"), maybe(rnd.randrange(4)), level(), maybe(rnd.random() < 0.5), maybe(rnd.random() < 0.4), maybe(float(rnd.randrange(0, 60)))) for i in range(n)]


def test_pool_sizes_count_what_the_join_makes(spark):
    """With nulls in every column, empty questions and an empty table."""
    df = spark.createDataFrame(made(150, 1) + made(40, 2, 2) + made(1, 3, 3) + made(30, 4, None), CANDS)
    assert pairs.pool_sizes(df).first().asDict() == pairs.measure_pools(pairs.candidate_pairs(df)).first().asDict()
    assert set(pairs.pool_sizes(df.limit(0)).first()) == {0}


def test_pool_sizes_make_no_pairs(spark):
    df = spark.createDataFrame(made(20, 1), CANDS)
    plan = pairs.pool_sizes(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan and "Generate" not in plan


def test_a_hot_question_is_dealt_to_many_tasks(spark):
    """One question of 3,000 rows in parts of 250: no key of the join has more than a square of parts."""
    df = spark.createDataFrame(made(3000, 7) + made(50, 8, 2), CANDS)
    sizes = pairs.pool_sizes(df).first().asDict()
    got = pairs.candidate_pairs(df, unit=250)
    assert pairs.measure_pools(got).first().asDict() == sizes and sizes["length"] > 40_000
    rows = df.where("level <> 'excluded'")
    cells = pairs._dealt(rows, 250).groupBy("question", "_part").count()
    parts = -(-rows.where("question = 1").count() // 250)
    assert cells.agg(F.max("count")).first()[0] < 400 and cells.where("question = 1").count() == parts > 5
