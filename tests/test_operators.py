"""Operators against golden facts, brute force and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import formatting, gates, ledger, merge, metrics, pairs, sampling, stats, validation


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_largest_remainder(spark):
    w = lambda x, n: {r[0]: r[2] for r in sampling.largest_remainder(spark.createDataFrame(x, "g string, n long"), "g", "n", n).collect()}
    assert sorted(w([("a", 110), ("b", 50), ("c", 35), ("d", 25), ("e", 20)], 60).values()) == [5, 6, 9, 12, 28]
    assert w([("big", 4), ("small", 1), ("med", 1)], 4) == {"big": 3, "med": 1, "small": 0}
    assert w([("a", 0)], 5) == {"a": 0} and w([], 5) == {}


def test_samples_repeat_whatever_the_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"))
    one = rows(sampling.stratified(df, ["g"], "id", 1, 20))
    assert one == rows(sampling.stratified(df.repartition(9).orderBy(F.rand(3)), ["g"], "id", 1, 20)) and len(one) == 60
    assert one != rows(sampling.stratified(df, ["g"], "id", 2, 20))
    assert rows(sampling.stratified(df.where("g = '1'"), ["g"], "id", 1, 20)) == [r for r in one if r[1] == "1"]
    held, rest = sampling.holdout(df, F.col("id") > 100, {"0": 5, "2": 7}, "g", "id", 3)
    assert held.count() == 12 and held.join(rest, "id").isEmpty() and held.count() + rest.count() == 500
    chunk = sampling.chunks(df, "id", 64).collect()
    assert all(r["chunk"] == r["id"] // 64 for r in chunk)


def model_of_sampling(pairs_, targets, per_q):
    """The greedy loop: buckets in turn, questions and pairs in hash order, first id wins."""
    picked, seen = [], set()
    for pool in pairs.POOLS:
        n, per = 0, {}
        for p in sorted((p for p in pairs_ if p[f"in_{pool.name}"]), key=lambda p: (p["_q"], p["_p"])):
            if n >= targets.get(pool.name, 0):
                break
            if p["pair_id"] in seen or per.get(p["question"], 0) >= per_q:
                continue
            seen.add(p["pair_id"])
            per[p["question"]] = per.get(p["question"], 0) + 1
            picked.append((pool.name, p["pair_id"]))
            n += 1
    return sorted(picked)


def test_pair_pools_and_first_wins(spark):
    rnd = random.Random(5)
    cands = [(q, f"k{i}", rnd.randrange(3), rnd.choice(["biased", "neutral", "unclear", "excluded"]), rnd.random() < 0.5, rnd.random() < 0.5, rnd.randrange(1, 40)) for q in range(40) for i in range(5)]
    df = spark.createDataFrame(cands, "question long, key string, model long, level string, hedged boolean, uncertain boolean, wc long")
    got = pairs.candidate_pairs(df)
    size = pairs.measure_pools(got).first().asDict()
    want = dict.fromkeys(size, 0)
    for a in cands:
        for b in cands:
            if a[0] != b[0] or a[1] == b[1]:
                continue
            bn = a[3] == "biased" and b[3] == "neutral"
            want["clear"] += bn and not a[4] and a[2] != b[2]
            want["subtle"] += bn and a[4]
            want["tracked"] += a[3] == "biased" and b[3] == "unclear"
            want["tie"] += a[3] == b[3] == "neutral" and a[2] != b[2] and a[1] < b[1]
            want["length"] += bn and b[6] >= 5 and a[6] >= 2 * b[6]
            want["confidence"] += bn and not a[4] and b[5]
    assert size == want == pairs.pool_sizes(df).first().asDict()
    assert rows(pairs.candidate_pairs(df, unit=2)) == rows(got)  # every question is dealt to three parts
    targets = {"clear": 12, "subtle": 9, "tracked": 30, "tie": 15, "confidence": 4, "length": 6}
    for cap in (1, 2):
        picked = pairs.sample_pairs(got, targets, 42, cap)
        from tallyloom.functions.hashing import hash_order, pair_id

        c = F.col
        full = got.withColumn("pair_id", pair_id(c("question").cast("string"), c("a_model").cast("string"), c("b_model").cast("string"))).withColumn("_q", hash_order(42, c("question"))).withColumn("_p", hash_order(42, c("question"), c("a_key"), c("b_key")))
        assert rows(picked.select("bucket", "pair_id")) == model_of_sampling([r.asDict() for r in full.collect()], targets, cap)
    assert pairs.sample_pairs(got, {}, 1, 1).count() == 0


def test_dynamic_caps():
    base, split = {"clear": 530, "subtle": 350, "tracked": 400, "tie": 400, "adversarial": 125}, {"confidence": 60, "length": 65}
    got = pairs.dynamic_caps(base, split, {"subtle": 200, "length": 200, "confidence": 50}, 0.7)
    assert got[0]["subtle"] == 140 and got[1]["confidence"] == 35 and got[0]["adversarial"] == 100
    assert pairs.dynamic_caps(base | {"adversarial": 0}, split, {"length": 9, "confidence": 9}, 0.7)[1] == {"length": 0, "confidence": 0}


def test_merge_patches(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, name string, v double")
    patch = spark.createDataFrame([("1", None, 1), ("2", 5.0, 1), ("2", 6.0, 2), ("9", 9.0, 1)], "k string, v double, seq int")
    assert rows(merge.merge_patches(base, patch, "k", ["seq"])) == [(1, "a", None), (2, "b", 6.0), (3, "c", 3.0)]
    assert merge.merge_counts(base, patch, "k").first().asDict() == {"base_rows": 3, "patch_rows": 4, "patched": 2, "unmatched": 1}


def test_compare_runs(spark):
    f = lambda x: spark.createDataFrame(x, "pair string, verdict string, confidence int")
    a = f([("1", "A", 3), ("2", "A", 3), ("3", "A", 3), ("4", None, None), ("5", "A", 1)])
    b = f([("1", "A", 3), ("2", "B", 4), ("3", "A", 4), ("4", None, None), ("6", "A", 1)])
    got = {r["pair"]: r["outcome"] for r in merge.compare_runs(a, b, "pair").collect()}
    assert got == {"1": "identical", "2": "verdict_flip", "3": "confidence_shift", "4": "identical", "5": "only_a", "6": "only_b"}


def test_resume_and_worklist(spark):
    work = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([("1",), (None,)], "k string")
    assert rows(merge.pending(work, done, done.limit(0), key="k")) == [(2,), (3,)]
    models = spark.createDataFrame([("m",), ("n",)], "m string")
    got = merge.worklist(work, models, spark.createDataFrame([(1, "m")], "k int, m string"), ["k", "m"])
    assert rows(got) == [(1, "n"), (2, "m"), (2, "n"), (3, "m"), (3, "n")]


def test_kappa_edges(spark):
    f = lambda x: metrics.kappa_by(spark.createDataFrame(x, "human string, model string"), []).first()
    assert f([("A", "A"), ("B", "B"), ("TIE", "TIE")])["kappa"] == 1.0
    assert f([("A", "A"), ("B", "B"), ("A", "PARSE_FAIL"), (None, "A")])["n"] == 2
    assert f([("A", "PARSE_FAIL")])["kappa"] is None and f([])["kappa"] is None and f([("A", "A")])["kappa"] is None
    assert f([("A", "B"), ("B", "A"), ("A", "A"), ("B", "B")])["kappa"] == 0.0


def test_position_truth_table(spark):
    v = ["A", "B", "TIE"]
    got = metrics.position_bias(spark.createDataFrame([(x + y, x, y) for x in v for y in v], "k string, plain string, swapped string"), ["k"])
    assert {r["k"] for r in got.collect() if r["position_bias"] == 0} == {"AB", "BA", "TIETIE"}
    fail = spark.createDataFrame([("PARSE_FAIL", "A"), ("A", "PARSE_FAIL")], "plain string, swapped string")
    assert metrics.position_bias(fail, []).first()["position_bias"] is None


def test_consistency_and_histogram(spark):
    d = spark.createDataFrame([("p", "A"), ("p", "A"), ("q", "A"), ("q", "B"), ("r", "A"), ("r", "PARSE_FAIL"), ("s", "A")], "pair string, verdict string")
    assert metrics.self_consistency(d, [], "pair", "verdict", 2).first().asDict() == {"self_consistency": 0.5, "n": 2}
    with pytest.raises(ValueError, match="two runs"):
        metrics.self_consistency(d, [], "pair", "verdict", 1)
    assert rows(metrics.histogram(d, "verdict", ["A", "TIE"])) == [("A", 5), ("TIE", 0)]
    assert rows(metrics.histogram(d.limit(0), "verdict", ["A"])) == [("A", 0)]


def test_percentiles(spark):
    d = lambda x: spark.createDataFrame([(float(v),) for v in x], "x double")
    lin = lambda x, p: stats.percentile_linear(d(x), [], "x", p).first()["percentile"]
    assert lin([], 0.5) == 0 and lin([42.0], 0.9) == 42 and [lin([1.0, 2, 3, 4, 5], p) for p in (0.5, 1.0, 0.0)] == [3, 5, 1]
    near = lambda x, p: stats.percentile_nearest(d(x), [], "x", p).first()["percentile"]
    rnd = random.Random(1)
    for n in (1, 2, 5, 18):
        x = [rnd.random() for _ in range(n)]
        for p in (0.5, 0.95):
            assert near(x, p) == sorted(x)[round(p * (n - 1))]
    assert near([], 0.5) is None


def test_gates(spark):
    g1 = lambda t, f, m: gates.generation(spark.createDataFrame([(t, f, m)], "total long, failed long, matches long")).first()["decision"]
    cases = [(40, 0, 40, 0), (40, 0, 20, 0), (40, 0, 4, 0), (40, 0, 3, 4), (40, 20, 20, 0), (40, 21, 0, 5), (0, 0, 0, 5), (40, 40, 0, 5)]
    assert [g1(*c[:3]) for c in cases] == [c[3] for c in cases]
    g2 = lambda o, h: gates.labeler(spark.createDataFrame([(o, h)], "overall long, hard long")).first()["decision"]
    assert [g2(46, 24), g2(45, 30), g2(50, 23), g2(50, 21)] == ["PROCEED", "REVIEW", "REVIEW", "ABORT"]
    b = lambda s, p, o=False: gates.budget(spark.createDataFrame([(s, p)], "spent double, projected double"), 10.0, o).first()["decision"]
    assert [b(5.0, 5.0), b(5.0, 5.1), b(5.0, 5.1, True), b(None, 1.0)] == ["PROCEED", "STOP", "OVERRIDE", "PROCEED"]

    def collapse(points):
        d = spark.createDataFrame([("r", i, *map(float, p)) for i, p in enumerate(points)], "run string, step int, margin double, accuracy double, chosen double, rejected double")
        return gates.overcollapse(d, ["run"], "step").first()["verdict"]

    assert collapse([(0.1, 0.6, -1, -1)]) == "INSUFFICIENT_DATA"
    assert collapse([(0.1, 0.6, -1, -1), (0.9, 0.8, -1, -2)]) == "OK"
    assert collapse([(0.1, 0.6, -1, -1), (0.15, 0.9, -1, -2)]) == "ABORT"
    assert collapse([(0.1, 0.6, -1, -1), (0.5, 0.9, -5, -5)]) == "ABORT"
    assert collapse([(0.1, 0.6, -1, -1), (0.5, 0.9, -3.5, -2)]) == "WARN"
    assert collapse([(0.1, 0.6, -1, -1), (0.9, 0.4, -1, -2)]) == "ABORT"


def test_validation(spark):
    d = spark.createDataFrame([(1, "a"), (1, "B "), (2, None)], "k int, s string")
    assert rows(validation.duplicates(d, ["k"])) == [(1, 2)] and rows(validation.unknown_values(d, "s", ["a"])) == [("B ", 1), (None, 1)]
    assert rows(validation.missing_counts(d, ["k", "s", "z"])) == [("k", 0), ("s", 1), ("z", 3)]
    assert validation.unnormalised(d, "s").count() == 1 and validation.forbidden(d, "B").count() == 1
    with pytest.raises(Exception, match="no k"):
        validation.demand(d, F.col("s").isNotNull(), "no k").collect()
    assert validation.dpo_pool(spark.createDataFrame([(5, "A"), (3, "A"), (5, "TIE"), (4, None)], "confidence int, verdict string")).count() == 2
    assert validation.sft_pool(spark.createDataFrame([(4,), (3,), (2,), (None,)], "confidence int")).count() == 2


def test_training_rows(spark):
    d = spark.createDataFrame([(f"p{i}", "q", "A. x", "first", "second", "Response A wins", "A") for i in range(20)], "pair_id string, question string, choices string, a string, b string, reasoning string, verdict string")
    sft = formatting.sft_rows(d).collect()
    assert len(sft) == 40
    for r in sft:
        assert ("**Response A:** " + ("second" if r["swap"] else "first")) in r["prompt"] and r["target"].endswith(f"<verdict>{'B' if r['swap'] else 'A'}</verdict>")
    synth = spark.createDataFrame([(f"p{i}", "made", "B") for i in range(10)], "pair_id string, reasoning string, verdict string")
    dpo = formatting.dpo_rows(d, synth).collect()
    assert all(r["chosen"] != r["rejected"] for r in dpo) and len(dpo) % 2 == 0
    known, unknown = formatting.with_pass(spark.createDataFrame([(0.0, True, 0), (0.3, False, 4), (0.7, False, 0)], "temperature double, swapped boolean, run_index int"))
    assert {r["pass"] for r in known.collect()} == {"swapped", "consistency_4"} and unknown.count() == 1


def test_ledger(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 1.0)], "g string, t int, c double")
    assert rows(ledger.running(d, ["g"], ["t"], "c").select("g", "t", "spent")) == [("a", 1, 2.0), ("a", 2, 5.0), ("b", 1, 1.0)]
    assert ledger.total(d.limit(0), "c").first()["total"] == 0
