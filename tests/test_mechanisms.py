"""Numbered lines of split files, nearest ids, chat templates, calls by partition, running sums of large groups."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import chat
from tallyloom.operators import ledger
from tallyloom.sources import connectors, jsonl, sinks


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_of_split_files_are_numbered(spark, tmp_path, small_splits):
    """Two files in dozens of splits, blank lines, lines longer than a split, line feeds at the end or not."""
    rnd, want = random.Random(3), []
    for name, end in (("a", "\n"), ("b", "")):
        lines = [rnd.choice(['{"k": 1}', '{"k": ', "", "   ", "x" * rnd.choice([3, 9000]), '{"k": 2}\r']) for _ in range(4000)] + ['{"k": 3}']
        (tmp_path / f"{name}.jsonl").write_bytes(("\n".join(lines) + end).encode())
        want += [(f"{name}.jsonl", i + 1, t) for i, t in enumerate(lines) if t.strip(" ") and not t.startswith('{"k": ' + t[6:7] + "}")]
    bad = jsonl.malformed_lines(spark, str(tmp_path), "k long")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["text"]) for r in bad.collect())
    assert got == sorted(want)
    every = jsonl.numbered_lines(spark, str(tmp_path / "a.jsonl"))
    assert [r["line"] for r in every.orderBy("line").select("line").collect()] == list(range(1, 4002))


def test_a_log_in_parts_is_numbered_through(spark, tmp_path, small_splits):
    """Parts of several splits, an empty one among them; each was sorted by a task of its own."""
    rnd = random.Random(4)
    keys = rnd.sample(range(10**6), 6000)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bad = F.concat(F.lit('{"k": '), "k", F.lit(" "), F.lpad(F.lit(""), 90, "x"))
    jsonl.write_log(df, f"{tmp_path}/log", F.col("k"), F.when(F.col("k") % 3 == 0, bad).otherwise(F.to_json(F.struct("k"))), rows=1000)
    parts = sorted((tmp_path / "log").glob("part-*"))
    assert len(parts) == 6 and max(p.read_text().count("\n") for p in parts) < 3000 and max(p.stat().st_size for p in parts) > 3 * 4096
    (tmp_path / "log" / "part-00002-and-none.txt").write_text("")
    got = sorted((r["line"], r["text"]) for r in jsonl.malformed_lines(spark, f"{tmp_path}/log", "k long", through=True).collect())
    assert got == [(i + 1, f'{{"k": {k} ' + "x" * 90) for i, k in enumerate(sorted(keys)) if k % 3 == 0]
    jsonl.write_log(df.where("k < 0"), f"{tmp_path}/none", F.col("k"), bad)
    assert jsonl.malformed_lines(spark, f"{tmp_path}/none", "k long", through=True).collect() == []


def test_no_task_sorts_the_log_of_all_orders(spark, tmp_path, monkeypatch):
    """The query on many parts gives the lines of a whole sort."""
    import hashlib

    from tallyloom.plans import record_queries

    rows = [(i * 7919 % 100_003, "PFO"[i % 3], f"{i % 5}-X") for i in range(5000)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(jsonl, "PART_ROWS", 400)
    monkeypatch.setattr(record_queries, "_at", lambda spark, name: f"{tmp_path}/{name}")
    got = sorted(tuple(r) for r in record_queries.s3_numbered_splits(spark, str(tmp_path)).collect())
    want = [(n + 1, hashlib.sha256(f'{{"k": {k} {p}'.encode()).hexdigest()) for n, (k, s, p) in enumerate(sorted(rows)) if s == "P"]
    assert got == want and len(list((tmp_path / "log").glob("part-*"))) > 8


def test_an_empty_file_has_no_lines(spark, tmp_path):
    (tmp_path / "e").write_text("")
    assert jsonl.malformed_lines(spark, str(tmp_path / "e"), "k long").collect() == []


def nearest_by_hand(wanted, known, most):
    runs = lambda s: {s[i : i + 3] for i in range(max(len(s) - 2, 1))}
    out = []
    for w in {w for w in wanted if w is not None} - set(known):
        held = [k for k in set(known) if k is not None and (w.lower() in k.lower() or w.split("/")[0] in k)]
        held.sort(key=lambda k: (w.lower() not in k.lower(), -len(runs(w.lower()) & runs(k.lower())), k))
        out += [(w, k, i + 1) for i, k in enumerate(held[:most])]
    return sorted(out)


def test_nearest_ids_against_all_pairs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abAB-1") for _ in range(rnd.randint(1, 7)))
    known = [word() + rnd.choice(["/", ""]) + word() for _ in range(150)] + [None, "a", "ab"]
    wanted = [word() + rnd.choice(["/", ""]) + rnd.choice(["", word()]) for _ in range(120)] + known[:20] + [None, "zzz/none", "A", "b/"]
    wanted = [w for w in wanted if w is None or w.split("/")[0]]  # an empty maker would be in every id
    table = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "model string, wanted int")
    got = sorted(tuple(r) for r in connectors.nearest(table(wanted), table(known), "model", 4).collect())
    assert got == nearest_by_hand(wanted, known, 4) and len(got) > 100
    assert connectors.nearest(table([]), table(known), "model").collect() == [] == connectors.nearest(table(["q"]), table([]), "model").collect()


def test_nearest_has_no_product(spark):
    df = spark.createDataFrame([("a",)], "model string")
    plan = connectors.nearest(df, df, "model")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def rendered(spark, template, messages, **more):
    df = spark.createDataFrame([(messages,)], "m array<struct<role: string, content: string>>")
    return df.select(template.render(F.col("m"), **more).alias("p")).first()["p"]


def test_chat_templates(spark):
    talk = [("system", " Be brief. "), ("user", " Hi\n"), ("assistant", "Yes?"), ("user", "Go")]
    t = chat.TEMPLATES
    assert rendered(spark, t["im"], talk[1:2]) == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n Hi\n<|im_end|>\n<|im_start|>assistant\n"
    assert rendered(spark, t["im"], talk, generation=False) == (
        "<|im_start|>system\n Be brief. <|im_end|>\n<|im_start|>user\n Hi\n<|im_end|>\n<|im_start|>assistant\nYes?<|im_end|>\n<|im_start|>user\nGo<|im_end|>\n"
    )
    head = lambda r: f"<|start_header_id|>{r}<|end_header_id|>\n\n"
    assert rendered(spark, t["header"], talk[:2]) == f"<|begin_of_text|>{head('system')}Be brief.<|eot_id|>{head('user')}Hi<|eot_id|>{head('assistant')}"
    assert rendered(spark, t["turn"], talk) == (
        "<bos><start_of_turn>user\nBe brief.\n\nHi<end_of_turn>\n<start_of_turn>model\nYes?<end_of_turn>\n<start_of_turn>user\nGo<end_of_turn>\n<start_of_turn>model\n"
    )
    assert rendered(spark, t["turn"], talk[1:2]) == "<bos><start_of_turn>user\nHi<end_of_turn>\n<start_of_turn>model\n"
    for one in t.values():
        assert rendered(spark, one, [("user", None)]) is not None and rendered(spark, one, None) is None
        with pytest.raises(Exception, match="forbidden"):
            rendered(spark, one, [("user", "x <|think|> y")])


def test_calls_make_a_client_a_partition(spark):
    """As many clients as partitions; errors are rows; the same answers as row-wise calls."""
    rows = [(i, f"p{i}", "ab"[i % 2] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, tenant string")

    def make():
        seen = []

        def call(prompt):
            seen.append(prompt)
            if prompt.endswith("7"):
                raise connectors.Permanent("no")
            return f"{prompt} of {len(seen)}"

        return call

    got = {r["id"]: r for r in connectors.call_partitions(df, make, "id", "text", "tenant").collect()}
    assert len(got) == 40 and all((got[i]["error"] == "Permanent") == (i % 10 == 7) for i in got)
    for part in ("a", "b", None):
        mine = sorted((r["nth"], i) for i, r in got.items() if r["client"] == part)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [i for _, i in mine] == sorted(i for _, i in mine)
        assert all(got[i]["text"] in (None, f"p{i} of {n}") for n, i in mine)
    plain = {r["id"]: r["error"] for r in connectors.call_rows(df, make, "id", "text").collect()}
    assert plain == {i: r["error"] for i, r in got.items()}


def test_running_sums_of_a_large_group(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot", "hot", "hot", "x", None]), rnd.choice([None, *range(60)]), i, rnd.choice([None, rnd.randrange(1000) / 100])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, t int, i long, c double")
    show = lambda d: sorted(map(repr, d.select("i", "spent").collect()))
    assert show(ledger.running(df, ["g"], ["t", "i"], "c", rows=50)) == show(ledger.running(df, ["g"], ["t", "i"], "c"))
    sizes = ledger.running(df, ["g"], ["t", "i"], "c", rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in sizes


def test_a_report_is_never_cut(spark):
    assert sinks.report(spark.range(3), "T", 3).count("\n") == 7
    with pytest.raises(ValueError, match="more than 3"):
        sinks.report(spark.range(4), "T", 3)
