import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import jsonl, sinks
from tallyloom.streaming import incremental


def test_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in jsonl.read_strict(spark, str(p), "a int").collect()) == [1, 2] and jsonl.count_lines(spark, str(p)) == 2
    p.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), "a int").collect()
    good, bad = jsonl.read_tolerant(spark, str(p), "a int")
    assert good.count() == 1 and bad.first()["_corrupt"] == '{"a": ' and bad.first()["_file"].endswith("a.jsonl")


def test_keys_and_labels(spark):
    d = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    keys, without = jsonl.key_set(d, "k")
    assert [r["k"] for r in keys.collect()] == ["1"] and without == 1
    e = spark.createDataFrame([(1, "A"), (2, None)], "k int, human_verdict string")
    with pytest.raises(Exception, match="is null"):
        jsonl.labelled_eval(e).collect()
    with pytest.raises(ValueError, match="no evaluation"):
        jsonl.labelled_eval(e.limit(0))


def test_batch_results(spark):
    line = {"custom_id": "x", "result": {"type": "succeeded", "message": {"stop_reason": "end", "content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 3}}}}
    fail = {"custom_id": "y", "result": {"type": "errored", "error": {"type": "t", "message": "m"}}}
    got = {r["custom_id"]: r for r in jsonl.message_results(spark.createDataFrame([(json.dumps(line),), (json.dumps(fail),), (" ",)], "value string")).collect()}
    assert got["x"]["text"] == "ab" and got["x"]["usage"] == {"input_tokens": 3} and got["y"]["error"] == "m" and got["y"]["text"] is None
    ok = {"custom_id": "x", "response": {"status_code": 200, "body": {"choices": [{"finish_reason": "stop", "message": {"content": "c"}}], "usage": {"prompt_tokens": 5, "prompt_tokens_details": {"cached_tokens": 2}}}}}
    f = lambda *x: spark.createDataFrame([(json.dumps(v),) for v in x], "value string")
    errors = f({"custom_id": "a", "error": {"message": "e1"}}, {"custom_id": "b", "response": {"status_code": 400, "body": {"error": {"message": "e2"}}}}, {"custom_id": "c", "response": {"status_code": 500}})
    got = {r["custom_id"]: r for r in jsonl.chat_results(f(ok), errors).collect()}
    assert got["x"]["text"] == "c" and got["x"]["usage"] == {"prompt_tokens": 5, "cached_tokens": 2} and got["x"]["stop_reason"] == "stop"
    assert [got[k]["error"] for k in "abc"] == ["e1", "e2", "http 500"] and {got[k]["status"] for k in "abc"} == {"errored"}


def test_sinks(spark, tmp_path):
    p, d = str(tmp_path / "t"), spark.range(5)
    sinks.write_once(d, p)
    with pytest.raises(Exception):
        sinks.write_once(d, p)
    sinks.replace(spark.read.parquet(p).where("id < 2"), p)  # the input may be the target
    assert spark.read.parquet(p).count() == 2 and not sinks.write_if_absent(d, p)
    sinks.append(d, p)
    assert spark.read.parquet(p).count() == 7
    (tmp_path / "t._staging-x").mkdir()
    assert sinks.clean_staging(spark, str(tmp_path)) == 1
    side = str(tmp_path / "s.json")
    assert jsonl.read_sidecar(spark, side) == {}
    sinks.upsert_json(spark, side, "a", {"n": 1})
    assert sinks.upsert_json(spark, side, "a", {"m": "é"}) == {"a": {"n": 1, "m": "é"}} == jsonl.read_sidecar(spark, side)
    sinks.write_routes(d.withColumn("route", F.when(F.col("id") > 2, "ok").otherwise("bad")), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("route").count().count() == 2
    a, b = sinks.table_digest(d), sinks.table_digest(d.repartition(3))
    assert a.collect() == b.collect() and a.collect() != sinks.table_digest(spark.range(6)).collect()
    assert [r["state"] for r in sinks.manifest(spark, str(tmp_path), {"s.json": "x", "none": "y"}).orderBy("local").collect()] == ["missing", "present"]
    assert sinks.archive(spark, str(tmp_path), ".json", str(tmp_path / "old")) == 1 == 1 - sinks.archive(spark, str(tmp_path), ".json", str(tmp_path / "old"))
    assert "| id |" in sinks.report(d, "T")


def test_streams(spark, tmp_path):
    src, base = tmp_path / "log", str(tmp_path / "base")
    src.mkdir()
    (src / "1.json").write_text('{"k": 1, "v": 5.0, "seq": 1, "ts": "2024-01-01T00:00:00Z"}\n{"k": 1, "v": 6.0, "seq": 2, "ts": "2024-01-01T00:01:00Z"}\n')
    spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, v double").write.parquet(base)
    schema = "k int, v double, seq int, ts timestamp"
    for _ in range(2):  # the second run has nothing new and changes nothing
        q = incremental.upsert_stream(incremental.log_stream(spark, str(src), schema), base, "k", ["seq"], str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert sorted(map(tuple, spark.read.parquet(base).collect())) == [(1, 6.0), (2, 0.0)]

    def memory(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    log = incremental.log_stream(spark, str(src), schema)
    assert len(memory(incremental.pending_stream(log, "k", "ts", "10 minutes"), "once", "append")) == 1
    spent = memory(incremental.spend_stream(log, "ts", "1 minute", "1 hour", ["k"], "v"), "spent", "complete")
    assert [(r["k"], r["spent"], r["n"]) for r in spent] == [(1, 11.0, 2)]
    assert memory(incremental.retry_stream(log, "k", "ts", "10 minutes"), "dead", "complete")[0]["failures"] == 2
    assert memory(incremental.phase_states(log.withColumn("status", F.concat(F.lit("s"), "seq")), "k", "ts", "status"), "phases", "complete")[0]["status"] == "s2"


def test_an_interrupted_replacement_is_undone(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.replace(spark.range(3), p)
    (tmp_path / "t").rename(tmp_path / "t._previous-x")  # stopped between the two renames
    assert sinks.recover(spark, p) and spark.read.parquet(p).count() == 3 and not sinks.recover(spark, p)
    sinks.replace(spark.range(5), p)
    assert spark.read.parquet(p).count() == 5 and [x.name for x in tmp_path.iterdir()] == ["t"]


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    src, base = tmp_path / "log", tmp_path / "base"
    src.mkdir()
    (src / "1.json").write_text('{"k": 7, "v": 5.0, "seq": 1}\n{"k": 7, "v": 6.0, "seq": 2}\n{"k": 9999, "v": 1.0, "seq": 1}\n')
    incremental.write_buckets(spark.range(200).selectExpr("cast(id as int) as k", "cast(0 as double) as v"), str(base), "k", 16)
    before = set(base.rglob("*.parquet"))
    stream = incremental.log_stream(spark, str(src), "k int, v double, seq int")
    incremental.upsert_stream(stream, str(base), "k", ["seq"], str(tmp_path / "cp")).awaitTermination(60)
    rows = {r["k"]: float(r["v"]) for r in spark.read.parquet(str(base)).collect()}
    assert len(rows) == 200 and rows[7] == 6.0 and sum(rows.values()) == 6.0
    assert len(before - set(base.rglob("*.parquet"))) == 1


def test_label_sessions_ask_again():
    from tallyloom.sources import connectors

    typed = iter(["what", "b 7", "b 2", "t", "k", "c", "q"])
    got = connectors.label_session([{"pair_id": i} for i in range(9)], lambda row: next(typed))
    assert got == [
        {"pair_id": 0, "human_verdict": "B", "confidence": 2, "notes": None}, {"pair_id": 1, "human_verdict": "TIE", "confidence": None, "notes": None},
        {"pair_id": 3, "human_verdict": None, "confidence": None, "notes": None},
    ]


def test_calls_give_up_after_their_attempts(spark, tmp_path):
    from tallyloom.sources import connectors

    spawned = []

    def fetch(call):
        raise OSError("lost")

    with pytest.raises(RuntimeError, match="6 times"):
        connectors.resume_calls(spark, str(tmp_path / "s.json"), ["a"], lambda n: spawned.append(n) or "c", fetch)
    assert len(spawned) == 6
