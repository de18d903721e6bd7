"""Scans with guards, sinks, host files and connectors (S, K, X), each run on its own folder, and single records (T, H, M, R, D, G).

What a query writes goes to the application's part of the shared folder and is read back from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import chat, cost, rules, text
from tallyloom.operators import formatting, gates, ledger, sampling, validation
from tallyloom.plans.analogues import DIALOGUE, dialogue, table
from tallyloom.plans.registry import query
from tallyloom.sources import config, connectors, jsonl, sinks
from tallyloom.sources.scratch import materialize, run_folder


def _at(spark, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _failed(call) -> str:
    """The class of the error that a guard raises."""
    try:
        call()
    except Exception as e:
        return type(e).__name__
    return "none"


# ---- scans -------------------------------------------------------------------------------------
def _event_lines(spark, d):
    good = F.to_json(F.struct("event_id", "event_type"))
    return table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), "event_id")).otherwise(good).alias("value"))


@query("select case when event_type = 'error' then 'malformed' else event_type end as kind, count(*)::bigint as n from events group by 1")
def s2_tolerant_lines(spark, d):
    path = _at(spark, "lines")
    _event_lines(spark, d).write.text(path)
    good, bad = jsonl.read_tolerant(spark, path, "event_id long, event_type string")
    kinds = good.select(F.col("event_type").alias("kind")).unionAll(bad.select(F.lit("malformed").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query("select (n_nationkey + 1)::int as line, '{\"k\": ' || n_nationkey as text from nation where n_regionkey = 2")
def s3_numbered_errors(spark, d):
    path, n = _at(spark, "cache"), table(spark, d, "nation")
    line = F.when(F.col("n_regionkey") == 2, F.concat(F.lit('{"k": '), "n_nationkey")).otherwise(F.to_json(F.struct(F.col("n_nationkey").alias("k"))))
    n.coalesce(1).sortWithinPartitions("n_nationkey").select(line.alias("value")).write.text(path)
    return jsonl.malformed_lines(spark, path, "k long").select("line", "text")


@query("""select line, sha256(t) as text_sha256 from (select row_number() over (order by o_orderkey) as line, '{"k": ' || o_orderkey || ' ' || o_orderpriority as t, o_orderstatus as s from orders)
  where s = 'P'""")
def s3_numbered_splits(spark, d):
    path, o = _at(spark, "log"), table(spark, d, "orders")
    bad = F.concat(F.lit('{"k": '), "o_orderkey", F.lit(" "), "o_orderpriority")
    line = F.when(F.col("o_orderstatus") == "P", bad).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k"))))
    jsonl.write_log(o, path, F.col("o_orderkey").asc_nulls_last(), line)
    return jsonl.malformed_lines(spark, path, "k long", through=True).select("line", F.sha2("text", 256).alias("text_sha256"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def s4_one_split(spark, d):
    path = _at(spark, "splits")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return jsonl.read_split(spark, path, "o_orderstatus", "F")


@query(f"select pair_id, question as prompt, verdict as target from {DIALOGUE}")
def s5_training_json(spark, d):
    path = _at(spark, "training")
    dialogue(spark, d).select("pair_id", F.col("question").alias("prompt"), F.col("verdict").alias("target")).write.json(path)
    return jsonl.read_strict(spark, path, "pair_id string, prompt string, target string")


@query("select doc_id, quality, 'FileNotFoundError' as without from labels")
def s7_guarded_scan(spark, d):
    error = _failed(lambda: jsonl.read_guarded(spark, _at(spark, "nothing"), "the labelling"))
    return jsonl.read_guarded(spark, f"{d}/labels.parquet", "the labelling").select("doc_id", "quality", F.lit(error).alias("without"))


@query("select * from (values ('there', 2::bigint), ('missing', 0::bigint), ('given', 1::bigint)) as t(name, keys)")
def s8_sidecar(spark, d):
    path = _at(spark, "side")
    sinks.write_json(spark, {"a": 1, "é": [2]}, path)
    found = [("there", jsonl.read_sidecar(spark, path)), ("missing", jsonl.read_sidecar(spark, path + "x")), ("given", jsonl.read_sidecar(spark, path + "x", {"d": 1}))]
    return spark.createDataFrame([(n, len(v)) for n, v in found], "name string, keys long")


@query("select * from (values ('whole', 'none'), ('short', 'KeyError'), ('empty', 'KeyError')) as t(name, error)")
def s13_required_keys(spark, d):
    configs = {"whole": {"train": {"lr": 0.1}, "out": "x"}, "short": {"train": {}, "out": "x"}, "empty": {}}
    return spark.createDataFrame([(n, _failed(lambda c=c: config.require_keys(c, ["train.lr", "out"]))) for n, c in configs.items()], "name string, error string")


@query("select r_regionkey, 'Rate ' || r_name || ':' as prompt, 'ValueError' as without from region")
def s14_template_file(spark, d):
    path = _at(spark, "template")
    spark.createDataFrame([("Rate {name}:",)], "value string").coalesce(1).write.text(path)
    template = config.load_text(spark, path, "{name}").rstrip("\n")
    error = _failed(lambda: config.load_text(spark, path, "{other}"))
    return table(spark, d, "region").select("r_regionkey", text.render(template, name=F.col("r_name")).alias("prompt"), F.lit(error).alias("without"))


@query("select r_regionkey, r_name from region")
def s15_fetched_by_name(spark, d):
    into = _at(spark, "fetched")
    sinks.copy_counted(spark, [f"{d}/region.parquet"], into)
    return spark.read.parquet(f"{into}/region.parquet").select("r_regionkey", "r_name")


@query("select n_nationkey, n_name, 'KeyError' as without from nation where n_nationkey in (3, 1, 7, 20)")
def s16_probe_rows(spark, d):
    n = table(spark, d, "nation")
    error = _failed(lambda: jsonl.probe_rows(n, "n_nationkey", [3, -5]))
    return jsonl.probe_rows(n, "n_nationkey", [3, 1, 7, 20]).select("n_nationkey", "n_name", F.lit(error).alias("without"))


@query("select r_regionkey, true as has_revision, true as has_user, true as is_utc from region")
def s19_provenance(spark, d):
    p = {k: F.lit(v) for k, v in config.provenance().items()}
    return table(spark, d, "region").select(
        "r_regionkey", (F.length(p["revision"]) > 0).alias("has_revision"), (F.length(p["user"]) > 0).alias("has_user"), p["at"].endswith("+00:00").alias("is_utc")
    )


# ---- sinks -------------------------------------------------------------------------------------
@query("select event_id, event_type from events")
def k1_appended(spark, d):
    path, e = _at(spark, "log"), table(spark, d, "events").select("event_id", "event_type")
    for part in (e.where("event_type = 'error'"), e.where("event_type <> 'error'")):
        sinks.append(part, path)
    return spark.read.parquet(path)


@query("select c_custkey, c_acctbal from customer where c_acctbal > 0")
def k2_replaced(spark, d):
    path = _at(spark, "table")
    sinks.replace(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path)
    sinks.replace(spark.read.parquet(path).where("c_acctbal > 0"), path)  # the input is the target
    return spark.read.parquet(path)


@query("select * from (values ('a', 2::bigint), ('b', 3::bigint)) as t(name, value)")
def k3_json_replaced(spark, d):
    path = _at(spark, "state")
    for value in ({"a": 1}, {"a": 2, "b": 3}):
        sinks.write_json(spark, value, path)
    return spark.createDataFrame(sorted(jsonl.read_sidecar(spark, path).items()), "name string, value long")


@query("select 2::bigint as removed, 0::bigint as again, (select count(*) from region)::bigint as kept")
def k4_stale_staging(spark, d):
    folder, r = _at(spark, "out"), table(spark, d, "region")
    r.write.parquet(f"{folder}/t")
    for i in range(2):
        r.write.parquet(f"{folder}/t._staging-{i}")
    removed, again = sinks.clean_staging(spark, folder), sinks.clean_staging(spark, folder)
    return spark.read.parquet(f"{folder}/t").agg(F.lit(removed).cast("long").alias("removed"), F.lit(again).cast("long").alias("again"), F.count("*").alias("kept"))


@query("select name, name = 'c' as there, 2::bigint as gone from (select unnest(['a', 'b', 'c', 'd']) as name)")
def k5_forced_overwrite(spark, d):
    folder = _at(spark, "outputs")
    for name in "abc":
        table(spark, d, "region").write.parquet(f"{folder}/{name}")
    gone = sinks.overwrite_named(spark, [f"{folder}/{n}" for n in "abd"])
    return spark.createDataFrame([(n, jsonl.exists(spark, f"{folder}/{n}"), gone) for n in "abcd"], "name string, there boolean, gone long")


@query("select r_regionkey, r_name, 'AnalysisException' as second from region")
def k6_locked_output(spark, d):
    path, r = _at(spark, "locked"), table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.write_once(r, path)
    error = _failed(lambda: sinks.write_once(r.limit(0), path))
    return spark.read.parquet(path).withColumn("second", F.lit(error))


@query("select * from (values (1, true, 5::bigint), (2, false, 5::bigint), (3, true, 0::bigint)) as t(step, wrote, n)")
def k7_skip_if_there(spark, d):
    path, r, rows = _at(spark, "once"), table(spark, d, "region"), []
    for step, (df, force) in enumerate(((r, False), (r.limit(0), False), (r.limit(0), True)), 1):
        rows.append((step, sinks.write_if_absent(df, path, force), spark.read.parquet(path).count()))
    return spark.createDataFrame(rows, "step int, wrote boolean, n long")


@query("""select route, coalesce(reason, '') as reason, count(*)::bigint as n from (select case when event_type = 'error' then 'batch_error' when event_id % 3 = 0 then 'ok' else 'parse_error' end as route,
  case when event_type = 'error' or event_id % 3 = 0 then null when event_id % 3 = 1 then 'wrong verdict' else 'no match' end as reason from events) group by 1, 2""")
def k9_synth_routes(spark, d):
    m = F.col("event_id") % 3
    made = lambda v: F.lit(f"<reasoning>r</reasoning><verdict>{v}</verdict>")
    e = table(spark, d, "events").select("event_id", F.when(m == 0, made("B")).when(m == 1, made("A")).otherwise("none").alias("out"), F.when(F.col("event_type") == "error", "errored").otherwise("succeeded").alias("status"))
    path = _at(spark, "routes")
    sinks.write_routes(formatting.routed_synth(e, "out", "status", text.flip_verdict(F.lit("A"))), path)
    return spark.read.parquet(path).groupBy("route", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("""select event_id::varchar as key, case event_id % 4 when 1 then 'auth' when 2 then 'rate_limit' else 'timeout' end as class from events where event_id % 4 <> 0""")
def k10_failure_rows(spark, d):
    m = F.col("event_id") % 4
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.when(m == 1, "AuthenticationError").when(m == 2, "HTTPError").when(m == 3, "APITimeoutError").alias("error"), F.when(m == 2, 429).alias("status"))
    return connectors.classified(e).select("key", "class")


@query("select '## Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) order by r_regionkey) || chr(10) as report from region")
def k11_markdown(spark, d):
    shown = sinks.report(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions")
    return spark.createDataFrame([(shown,)], "report string")


@query("select * from (values ('label', 'n', 5::bigint), ('label', 'cost', 2::bigint), ('check', 'n', 7::bigint)) as t(phase, name, value)")
def k13_phase_metadata(spark, d):
    path = _at(spark, "meta")
    for phase, entry in (("label", {"n": 4}), ("check", {"n": 7}), ("label", {"n": 5, "cost": 2})):
        sinks.upsert_json(spark, path, phase, entry)
    rows = [(p, k, v) for p, e in jsonl.read_sidecar(spark, path).items() for k, v in e.items()]
    return spark.createDataFrame(rows, "phase string, name string, value long")


@query("select * from (values ('a.jsonl', true), ('b.jsonl', true), ('c.txt', false)) as t(name, archived)")
def k15_archived(spark, d):
    folder = _at(spark, "caches")
    for name in ("a.jsonl", "b.jsonl", "c.txt"):
        sinks.write_json(spark, {}, f"{folder}/{name}")
    moved = [sinks.archive(spark, folder, ".jsonl", f"{folder}/old") for _ in range(2)]
    assert moved == [2, 0]
    return spark.createDataFrame([(n, jsonl.exists(spark, f"{folder}/old/{n}")) for n in ("a.jsonl", "b.jsonl", "c.txt")], "name string, archived boolean")


@query("select * from (values ('now', 2::bigint), ('backup', 1::bigint)) as t(name, value)")
def k16_backup(spark, d):
    path = _at(spark, "labels")
    sinks.write_json(spark, {"v": 1}, path)
    copy = config.backup(spark, path, "20240101T000000Z")
    sinks.write_json(spark, {"v": 2}, path)
    return spark.createDataFrame([("now", jsonl.read_sidecar(spark, path)["v"]), ("backup", jsonl.read_sidecar(spark, copy)["v"])], "name string, value long")


@query("select v || '-' || t as name, 'FROM ' || v || chr(10) || 'T ' || t as text from (select unnest(['sft', 'dpo']) as v), (select unnest(['chat', 'plain', 'tools']) as t)")
def k18_rendered_files(spark, d):
    files = config.render_variants("FROM {variant}\nT {chat}", variant=["sft", "dpo"], chat=["chat", "plain", "tools"])
    return spark.createDataFrame([("-".join(k), v) for k, v in files.items()], "name string, text string")


@query("select name, name <> 'nothing.parquet' as copied, case when name = 'nothing.parquet' then 'missing' else 'copied' end as state from (select unnest(['region.parquet', 'nation.parquet', 'nothing.parquet']) as name)")
def k19_upload(spark, d):
    got = sinks.copy_counted(spark, [f"{d}/{n}.parquet" for n in ("region", "nation", "nothing")], _at(spark, "volume"))
    return got.select("name", (F.coalesce("bytes", F.lit(0)) > 0).alias("copied"), "state")


# ---- validation, order, merging ----------------------------------------------------------------
@query("select doc_id, lang, 'KeyError' as with_unknown from documents where doc_id in (select doc_id from labels where quality = 1)")
def p20_required_subset(spark, d):
    docs, keys = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("quality = 1").select("doc_id")
    error = _failed(lambda: validation.required_subset(docs, keys.unionAll(spark.range(-1, 0).toDF("doc_id")), "doc_id"))
    return validation.required_subset(docs, keys, "doc_id").withColumn("with_unknown", F.lit(error))


@query("select * from (values ('base', ''), ('tuned', '/m/tuned')) as t(name, path)")
def p22_target_names(spark, d):
    assert _failed(lambda: config.targets_with_baseline(["a", "b"], ["/m/a"])) == "ValueError"
    return spark.createDataFrame([(n, p or "") for n, p in config.targets_with_baseline(["tuned"], ["/m/tuned"], "base")], "name string, path string")


@query("select event_type, sum((event_id % 5 > 0)::int)::bigint as cache_hits, sum(event_id % 5)::bigint as cached, count(*)::bigint as requests from events group by 1")
def a23_cache_hits(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 5).alias("cached"))
    return ledger.usage_totals(e, ["event_type"], ["cached"])


@query("select o_orderkey, o_orderdate, true as ordered from orders")
def w18_sorted_write(spark, d):
    path = _at(spark, "sorted")
    sinks.sorted_write(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), path, ["o_orderkey"])
    rows = spark.read.parquet(path).select("o_orderkey", "o_orderdate", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    # Files cover ranges, and rows follow each other inside: both are counted by file, without a sort of the whole.
    files = rows.groupBy("f").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    wrong = files.alias("a").join(files.alias("b"), F.expr("a.f < b.f and a.lo <= b.hi and b.lo <= a.hi")).count()
    before = F.lag("o_orderkey").over(Window.partitionBy("f").orderBy("i"))
    return rows.select("o_orderkey", "o_orderdate", (F.coalesce(before <= F.col("o_orderkey"), F.lit(True)) & F.lit(wrong == 0)).alias("ordered"))


@query("select doc_id, lang, case when quality = 0 then 'low' else 'good' end as kind, coalesce(toxic, -1) as toxic from documents join labels using (doc_id)")
def r4_merged_maps(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    whole = rules.merged(m(lang=F.col("lang"), kind=F.lit("good")), m(toxic=F.col("toxic")), F.when(F.col("quality") == 0, m(kind=F.lit("low"))))
    at = lambda k: F.try_element_at(whole, F.lit(k))
    return j.select("doc_id", at("lang").alias("lang"), at("kind").alias("kind"), F.coalesce(at("toxic").cast("int"), F.lit(-1)).alias("toxic"))


# ---- text and numbers --------------------------------------------------------------------------
@query(rf"select doc_id, regexp_matches(case when doc_id % 3 = 0 then 'Hard to say. ' else '' end || text, '(?i)\b(?:{'|'.join(p.replace(' ', chr(92) + 's+').replace(chr(39), chr(39) * 2) for p in text.HEDGES + text.UNCERTAIN)})\b') as uncertain from documents")
def t9_uncertain(spark, d):
    said = F.concat(F.when(F.col("doc_id") % 3 == 0, "Hard to say. ").otherwise(""), "text")
    return table(spark, d, "documents").select("doc_id", text.is_uncertain(said).alias("uncertain"))


_MESSAGE = "'**Question:** ' || question || chr(10) || chr(10) || '**Answer choices:**' || chr(10) || 'A. x' || chr(10) || chr(10) || '**Response A:** ' || case when swap then b else a end || chr(10) || chr(10) || '**Response B:** ' || case when swap then a else b end || chr(10) || chr(10) || '" + text.VERDICT_QUESTION.replace("\n", "' || chr(10) || '") + "'"


@query(f"select pair_id, swap, sha256({_MESSAGE}) as message from (select *, unnest([false, true]) as swap from {DIALOGUE})")
def t18_user_message(spark, d):
    c = F.col
    rows = dialogue(spark, d).withColumn("swap", F.explode(F.array(F.lit(False), F.lit(True))))
    return rows.select("pair_id", "swap", F.sha2(text.user_message(c("question"), F.lit("A. x"), c("a"), c("b"), c("swap")), 256).alias("message"))


_TRIMMED = f"trim({_MESSAGE}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""select pair_id, swap, sha256('<bos><start_of_turn>user' || chr(10) || 'Judge.' || chr(10) || chr(10) || {_TRIMMED} || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)) as prompt_sha256
  from (select *, unnest([false, true]) as swap from {DIALOGUE})""")
def j22_sft_chat_template(spark, d):
    rows = dialogue(spark, d).withColumn("choices", F.lit("A. x"))
    made = formatting.sft_rows(rows, "Judge.", chat.TEMPLATES["turn"])
    return made.select("pair_id", "swap", F.sha2("prompt", 256).alias("prompt_sha256"))


_TEMPLATES = {"whole": "Use OK.\n## Task\nRate.\n## Pair\n{a} and {b}", "no token": "## Pair\n{a} {b}", "doubled": "OK {{a}} {b}", "short": "OK {a}"}


@query("select * from (values ('whole', 'none'), ('no token', 'ValueError'), ('doubled', 'ValueError'), ('short', 'ValueError')) as t(name, error)")
def t21_template_checks(spark, d):
    return spark.createDataFrame([(n, _failed(lambda t=t: text.verify_template(t, "OK", ["a", "b"]))) for n, t in _TEMPLATES.items()], "name string, error string")


@query("select 'Use OK.' || chr(10) || '## Task' || chr(10) || 'Rate.' || chr(10) as prefix, '## Pair' || chr(10) || r_name || ' and ' || r_regionkey as suffix from region")
def t22_prefix_and_suffix(spark, d):
    prefix, suffix = text.split_template(_TEMPLATES["whole"])
    return table(spark, d, "region").select(F.lit(prefix).alias("prefix"), text.render(suffix, a=F.col("r_name"), b=F.col("r_regionkey").cast("string")).alias("suffix"))


@query(r"""select doc_id, len(t)::int as n, list_aggregate(list_transform(t, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 50000), 'string_agg', ' ') as ids, len(t)::int as mask
  from (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')[1:64] as t from documents) where len(t) > 0""")
def t33_tokenised(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.hashed_ids(F.col("text"), 64).alias("ids")).where("size(ids) > 0")
    mask = F.aggregate(text.attention_mask(F.col("ids")), F.lit(0), lambda a, x: a + x)
    return t.select("doc_id", F.size("ids").alias("n"), F.array_join("ids", " ").alias("ids"), mask.alias("mask"))


@query("select 'x' as name, sha256('[' || chr(10) || '  1' || chr(10) || ']') as digest")
def h6_file_digest(spark, d):
    path = _at(spark, "file")
    sinks.write_json(spark, [1], path)
    return spark.createDataFrame([("x", sinks.file_sha256(spark, path))], "name string, digest string")


@query("select l_orderkey, round(sum(l_extendedprice * l_tax), 6) as cost, round(sum(l_extendedprice), 4) as total, round(sum(l_quantity), 2) as seconds from lineitem group by 1")
def m6_report_rounding(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("a"), F.sum("l_extendedprice").alias("b"), F.sum("l_quantity").alias("c"))
    return g.select("l_orderkey", cost.reported(F.col("a")).alias("cost"), cost.reported(F.col("b"), 4).alias("total"), cost.reported(F.col("c"), 2).alias("seconds"))


@query("select o_orderkey, round(o_totalprice / nullif(o_orderkey % 3, 0), 9) as as_null, coalesce(round(o_totalprice / nullif(o_orderkey % 3, 0), 9), 0) as as_zero from orders")
def m7_guarded_ratio(spark, d):
    a, b = F.col("o_totalprice"), F.col("o_orderkey") % 3
    return table(spark, d, "orders").select("o_orderkey", F.round(cost.ratio(a, b), 9).alias("as_null"), F.round(cost.ratio(a, b, 0.0), 9).alias("as_zero"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as at from events")
def d1_iso_stamp(spark, d):
    return table(spark, d, "events").select("event_id", rules.iso_stamp(F.col("ts")).alias("at"))


# ---- states and gates --------------------------------------------------------------------------
@query("select * from (values ('new', 'empty'), ('same', 'clean'), ('more', 'mismatch'), ('changed', 'mismatch'), ('lost', 'mismatch')) as t(name, state)")
def c8_resume_state(spark, d):
    cases = {"new": (0, None, None, None), "same": (5, 5, "x", "x"), "more": (6, 5, "x", "x"), "changed": (5, 5, "x", "y"), "lost": (0, 5, "x", "x")}
    return spark.createDataFrame([(n, config.resume_state(*c)) for n, c in cases.items()], "name string, state string")


@query("""select * from (values ('whole', 'PROCEED', 'complete'), ('none', 'STOP', 'no dry run'), ('short', 'STOP', '9 of 10 records'), ('long', 'STOP', 'length gate failed')) as t(name, decision, reason)""")
def g12_dry_run_gate(spark, d):
    cases = {"whole": [(10, 1.1)], "none": [], "short": [(9, 1.1)], "long": [(10, 1.6)]}
    out = None
    for name, rows in cases.items():
        g = gates.dry_run_complete(spark.createDataFrame(rows, "n_records long, ratio double"), 10, 1.25).select(F.lit(name).alias("name"), "decision", "reason")
        out = g if out is None else out.unionAll(g)
    return out


@query("select name, case when name = 'nothing' then 'missing' when name = 'region' then 'too small' else 'ok' end as state from (select unnest(['documents', 'region', 'nothing']) as name)")
def g14_artifacts(spark, d):
    have = sinks.manifest(spark, d, {f"{n}.parquet": n for n in ("documents", "region")}).select(F.col("remote").alias("name"), "bytes")
    return gates.artifacts(have, spark.createDataFrame([("documents",), ("region",), ("nothing",)], "name string"), 5_000)


@query("select 'mask' as gate, 'FAIL' as decision, (count(*) filter (event_id % 7 = 0)) || ' of ' || count(*) || ' rows' as reason from events")
def g15_mask_sanity(spark, d):
    e = F.col("event_id")
    labels = F.when(e % 7 == 0, F.array(F.lit(-100), F.lit(-100))).otherwise(F.array(F.lit(-100), (e % 50).cast("int")))
    return gates.mask_sanity(table(spark, d, "events").select(labels.alias("labels")), "labels")


# ---- connectors --------------------------------------------------------------------------------
@query("select * from (values (1, 'b-1', 3::bigint), (2, 'b-1', 3::bigint)) as t(run, batch, calls)")
def x1_submit(spark, d):
    path, calls, rows = _at(spark, "state"), [], []

    def send() -> str:
        calls.append(1)
        if len(calls) < 3:
            raise OSError("try again")
        return "b-1"

    for run in (1, 2):  # the second run finds the batch in the state
        batch = connectors.submit(spark, path, "label", "m", "p", 5, send, "2024-01-01T00:00:00Z", sleep=lambda s: None)
        rows.append((run, batch, len(calls)))
    return spark.createDataFrame(rows, "run int, batch string, calls long")


@query("select * from (values ('ends', 'ended'), ('once', 'in_progress'), ('breaks', 'OSError')) as t(name, outcome)")
def x2_poll(spark, d):
    def script(*steps):
        left = list(steps)

        def status() -> str:
            s = left.pop(0)
            if isinstance(s, Exception):
                raise s
            return s

        return status

    wait = {"sleep": lambda s: None}
    rows = [("ends", connectors.poll(script("in_progress", OSError(), "in_progress", "ended"), **wait)), ("once", connectors.poll(script("in_progress"), once=True, **wait))]
    rows.append(("breaks", _failed(lambda: connectors.poll(script(*[OSError()] * 5), **wait))))
    return spark.createDataFrame(rows, "name string, outcome string")


@query("select o_orderkey, chunk from (select o_orderkey, ((row_number() over (order by o_orderkey) - 1) // 250)::bigint as chunk from orders) where chunk % 2 = 1")
def x3_open_chunks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    done = sampling.chunks(o, "o_orderkey", 250).where("chunk % 2 = 0").select("chunk")
    return connectors.chunk_plan(o, done, "o_orderkey", 250).select("o_orderkey", F.col("chunk").cast("long").alias("chunk"))


def _client():
    def call(prompt: str) -> str:
        if "o" in prompt:
            raise connectors.Permanent("refused")
        return prompt[::-1]

    return call


@query("select c_custkey, case when contains(c_mktsegment, 'O') then '' else reverse(lower(c_mktsegment)) end as text, case when contains(c_mktsegment, 'O') then 'Permanent' else '' end as error from customer")
def x4_fan_out(spark, d):
    r = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("prompt"))
    out = materialize(connectors.call_rows(r, _client, "c_custkey", "prompt"), "calls")
    return out.select("c_custkey", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("")).alias("error"))


class _Status(Exception):
    def __init__(self, status: int):
        self.status = status


@query("select * from (values ('a', 'ok'), ('b', 'not_found'), ('c', 'transient'), ('d', 'stopped')) as t(model, state)")
def x5_preflight(spark, d):
    def probe(model: str) -> None:
        if model in "bcd":
            raise _Status({"b": 404, "c": 503, "d": 401}[model])

    stopped = _failed(lambda: connectors.preflight(spark, ["a", "d"], probe)) == "_Status"
    return connectors.preflight(spark, ["a", "b", "c"], probe).unionAll(spark.createDataFrame([("d", "stopped" if stopped else "")], "model string, state string"))


@query("select n_name from nation where contains(lower(n_name), 'an') and n_name <> 'an' order by n_name limit 10")
def x6_known_models(spark, d):
    return connectors.suggestions("an", table(spark, d, "nation"), "n_name")


@query("select c_custkey, case when c_nationkey < 10 then 'cached' else reverse(lower(c_mktsegment)) end as text from customer where c_nationkey < 10 or not contains(c_mktsegment, 'O')")
def x7_cache_first(spark, d):
    r = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lower("c_mktsegment").alias("prompt"))
    cache = r.where("c_nationkey < 10").select("c_custkey", F.lit("cached").alias("text"))
    return materialize(connectors.cached_calls(r.drop("c_nationkey"), cache, _client, "c_custkey", "prompt"), "cached-calls")


@query("select s_suppkey, p as pass, sha256('s' || chr(0) || s_name) as prompt_hash, reverse(s_name) as text from (select *, unnest(['original', 'swapped']) as p from supplier)")
def x8_batched_inference(spark, d):
    from tallyloom.functions.hashing import prompt_hash

    r = table(spark, d, "supplier").select(F.col("s_suppkey"), "s_name", F.explode(F.array(F.lit("original"), F.lit("swapped"))).alias("pass"))
    r = r.withColumn("key", F.concat_ws("|", "s_suppkey", "pass"))
    out = materialize(connectors.call_rows(r, lambda: lambda p: p[::-1], "key", "s_name"), "batched").select("key", "text")
    return r.join(out, "key").select("s_suppkey", "pass", prompt_hash(F.lit("s"), F.col("s_name")).alias("prompt_hash"), "text")


@query("select * from (values ('a', 'done a-1', 1::bigint), ('b', 'done b-2', 2::bigint), ('c', 'done c-1', 1::bigint)) as t(name, result, spawned)")
def x9_resumed_calls(spark, d):
    path, spawned, asked = _at(spark, "calls"), {}, {}

    def spawn(name: str) -> str:
        spawned[name] = spawned.get(name, 0) + 1
        return f"{name}-{spawned[name]}"

    def fetch(call: str) -> str | None:
        asked[call] = asked.get(call, 0) + 1
        if call == "b-1":
            raise OSError("lost")
        return None if call == "c-1" and asked[call] == 1 else f"done {call}"

    first = connectors.resume_calls(spark, path, ["a", "b", "c"], spawn, fetch)
    assert sorted(first) == ["a", "b"]  # c is in flight, and a second run fetches it
    done = connectors.resume_calls(spark, path, ["a", "b", "c"], spawn, fetch)
    return spark.createDataFrame([(n, done[n], spawned[n]) for n in sorted(done)], "name string, result string, spawned long")


def _stream():
    def call(prompt: str):
        if prompt.startswith("m"):
            return
        yield from prompt.split("u")

    return call


@query("select c_custkey, case when starts_with(c_mktsegment, 'M') then 0 else len(string_split(lower(c_mktsegment), 'u')) end::int as pieces, starts_with(c_mktsegment, 'M') as degraded, true as timed from customer")
def x10_timed_calls(spark, d):
    r = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("prompt"))
    out = materialize(connectors.timed_calls(r, _stream, "c_custkey", "prompt"), "timed")
    return out.select("c_custkey", "pieces", "degraded", ((F.col("ttft_s") <= F.col("total_s")) & (F.col("total_s") >= 0)).alias("timed"))


@query("""select c_custkey, case when contains(c_mktsegment, 'O') then null else reverse(lower(c_mktsegment)) end as text, case when contains(c_mktsegment, 'O') then 'Permanent' end as error,
  count(*) over (partition by c_nationkey)::bigint as calls from customer""")
def x4_calls_by_partition(spark, d):
    r = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lower("c_mktsegment").alias("prompt"))
    out = materialize(connectors.call_partitions(r, _client, "c_custkey", "prompt", "c_nationkey", attempts=1), "udtf-calls")
    calls = out.groupBy("client").agg(F.max("nth").alias("calls"))  # a client serves one partition, in which it counts its calls
    return out.join(calls, "client").select("c_custkey", "text", "error", "calls")


@query("select n_nationkey, reverse(n_name) as text from nation where n_nationkey in (2, 5, 11)")
def x11_probe_generation(spark, d):
    probes = jsonl.probe_rows(table(spark, d, "nation"), "n_nationkey", [2, 5, 11])
    return materialize(connectors.call_rows(probes, lambda: lambda p: p[::-1], "n_nationkey", "n_name"), "probes").select("n_nationkey", "text")


@query("""select r_regionkey, case when r_regionkey = 0 then 'A' when r_regionkey = 2 then 'TIE' else '' end as human_verdict, case when r_regionkey = 0 then 4 else -1 end as confidence,
  case when r_regionkey = 0 then 'a note of it' else '' end as notes, r_regionkey = 3 as cleared from region""")
def x12_label_session(spark, d):
    from tallyloom.operators.merge import merge_patches

    base = table(spark, d, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 3, "B").alias("human_verdict"), F.lit(None).cast("int").alias("confidence"), F.lit(None).cast("string").alias("notes"))
    typed = iter(["x", "a 9", "A 4 a note of it", "s", "t", "c", "q"])
    said = connectors.label_session([{"r_regionkey": i} for i in range(5)], lambda row: next(typed), "r_regionkey")
    patches = spark.createDataFrame([(p["r_regionkey"], p["human_verdict"], p["confidence"], p["notes"], i) for i, p in enumerate(said)], "r_regionkey long, human_verdict string, confidence int, notes string, nth int")
    done = merge_patches(base, patches, "r_regionkey", ["nth"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    return done.select("r_regionkey", blank("human_verdict").alias("human_verdict"), F.coalesce("confidence", F.lit(-1)).alias("confidence"), blank("notes").alias("notes"), ((F.col("r_regionkey") == 3) & F.col("human_verdict").isNull()).alias("cleared"))

