"""The whole plan on made-up questions, and the connectors behind it."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import curation
from tallyloom.sources import config, connectors


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(3)
    qs = [(f"q{i}", rnd.randrange(3), rnd.randrange(3), rnd.choice(["ambig", "disambig"]), "Some context.", "Who?", "x", "y", "z", rnd.choice(["age", "religion"])) for i in range(120)]
    cs = [(f"q{i}", m, f"{rnd.choice(['', 'probably ', 'it depends, '])}{'word ' * rnd.randint(0, 12)}<answer>{rnd.choice('ABC')}</answer>", rnd.choice(["stop"] * 9 + ["length"])) for i in range(121) for m in "wxyz"]
    q = spark.createDataFrame(qs, "question_id string, answer_label int, target_label int, context_condition string, context string, question string, ans0 string, ans1 string, ans2 string, category string")
    return q, spark.createDataFrame(cs, "question_id string, model string, response string, finish_reason string")


def test_plan(spark, world):
    q, c = world
    enriched, missed = curation.enrich(c, q)
    assert missed.count() == 4 and enriched.count() == 480
    notes = curation.annotate(enriched).persist()
    targets = {"clear": 20, "subtle": 10, "tracked": 15, "tie": 20, "confidence": 5, "length": 5}
    pairs = curation.build_pairs(notes, targets, 42).persist()
    got = {r["pair_category"]: r["count"] for r in pairs.groupBy("pair_category").count().collect()}
    assert all(0 < got[k] <= targets[k] for k in got) and pairs.count() == pairs.select("pair_id").distinct().count() == sum(got.values())
    assert pairs.groupBy("question_id", "pair_category").count().where("count > 1").isEmpty()
    assert not {"answer_label", "target_label"} & set(pairs.columns)
    again = curation.build_pairs(notes, targets, 42, seen=pairs)
    assert again.join(pairs, "pair_id").isEmpty()
    with_cat = pairs.join(q.select("question_id", "category"), "question_id")
    parts = curation.split(with_cat, "religion", {"clear": 4, "tie": 4}, 6, "category", 1)
    sizes = {k: v.count() for k, v in parts.items()}
    assert sizes["in_distribution"] == 8 and sizes["held_out"] == 6 and sum(sizes.values()) == pairs.count()
    assert "suspected_bias_level" not in parts["held_out"].schema["response_a"].dataType.fieldNames()
    labelled = parts["to_label"].withColumn("verdict", F.lit("A")).withColumn("reasoning", F.lit("Response A stereotypes")).withColumn("confidence", F.lit(4))
    synth = labelled.select("pair_id", F.lit("made").alias("reasoning"), F.lit("B").alias("verdict"))
    sft, dpo = curation.training_sets(labelled, synth)
    assert sft.count() == dpo.count() == 2 * sizes["to_label"] and dpo.where("chosen = rejected").isEmpty()


def test_calls_become_rows(spark):
    def make():
        def client(p):
            if "bad" in p:
                raise connectors.Permanent("no")
            return p.upper()

        return client

    d = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k int, p string")
    got = {r["k"]: r for r in connectors.call_rows(d, make, "k", "p", base=0.0).collect()}
    assert got[1]["text"] == "A" and got[2]["error"] == "Permanent" and got[2]["text"] is None
    cache = spark.createDataFrame([(1, "old")], "k int, text string")
    assert sorted(map(tuple, connectors.cached_calls(d, cache, make, "k", "p").collect())) == [(1, "old"), (3, "C")]
    assert connectors.classified(connectors.call_rows(d, make, "k", "p", base=0.0)).first()["class"] == "unknown"


def test_retries_polls_states(spark, tmp_path):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "b1"

    assert connectors.with_retries(flaky, sleep=waits.append) == "b1" and waits == [1.0, 2.0]
    with pytest.raises(connectors.Permanent):
        connectors.with_retries(lambda: (_ for _ in ()).throw(connectors.Permanent()), sleep=waits.append)
    seq = iter(["running", OSError(), "ended"])

    def status():
        s = next(seq)
        if isinstance(s, Exception):
            raise s
        return s

    assert connectors.poll(status, sleep=waits.append) == "ended"
    path = str(tmp_path / "state.json")
    args = (spark, path, "label", "m", "p", 3)
    assert connectors.submit(*args, lambda: "x1", "now") == "x1" == connectors.submit(*args, lambda: "x2", "now")

    class Gone(Exception):
        status = 404

    def probe(m):
        if m == "old":
            raise Gone

    assert {r["model"]: r["state"] for r in connectors.preflight(spark, ["old", "new"], probe).collect()} == {"old": "not_found", "new": "ok"}
    with pytest.raises(RuntimeError, match="no model"):
        connectors.preflight(spark, ["old"], probe)
    known = spark.createDataFrame([("Acme-7b-chat",), ("acme-7b/x",), ("other",)], "model string")
    assert [r["model"] for r in connectors.suggestions("acme-7b", known).collect()] == ["Acme-7b-chat", "acme-7b/x"]
    plan = connectors.chunk_plan(spark.range(10), spark.createDataFrame([(0,)], "chunk long"), "id", 4)
    assert sorted(r["id"] for r in plan.collect()) == [4, 5, 6, 7, 8, 9]


def test_host_files(spark, tmp_path):
    with pytest.raises(KeyError, match="a.b"):
        config.require_keys({"a": {}}, ["a.b"])
    p = tmp_path / "t.txt"
    p.write_text("hello {x}")
    assert config.load_text(spark, str(p), "{x}") == "hello {x}"
    assert open(config.backup(spark, str(p), "s")).read() == "hello {x}"
    assert config.render_variants("{a}-{b}", a=["1"], b=["2", "3"]) == {("1", "2"): "1-2", ("1", "3"): "1-3"}
    assert [config.resume_state(*x) for x in ((0, None, None, None), (3, 3, "h", "h"), (3, 3, "h", "i"))] == ["empty", "clean", "mismatch"]
    assert config.targets_with_baseline(["a"], ["p"], "base") == [("base", None), ("a", "p")]
    assert set(config.provenance()) == {"revision", "user", "at"}
