"""Scans, joins, membership, merges, validation and sets (S, J, P, U, K, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import formatting, merge, metrics, validation
from tallyloom.plans.analogues import DIALOGUE, SAMPLED, TRUTH, WIDE, dialogue, sampled, table, truth, wide
from tallyloom.plans.registry import query
from tallyloom.sources import connectors, jsonl, sinks


# ---- sources -----------------------------------------------------------------------------------
@query("select user_id::varchar as user_id from events where user_id is not null group by 1")
def s18_resume_keys(spark, d):
    return jsonl.key_set(table(spark, d, "events"), "user_id")[0]


@query("select count(*)::bigint as n from (select unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> ''")
def s9_non_blank_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return lines.where(F.trim("value") != "").agg(F.count("*").alias("n"))


@query("select event_id, event_type, (props::json ->> '$.k')::bigint as k from events")
def s1_json_lines(spark, d):
    lines = table(spark, d, "events").select("event_id", "event_type", "props")
    return lines.select("event_id", "event_type", F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"].alias("k"))


def _message_lines(spark, d):
    e = table(spark, d, "events")
    ok = F.col("event_type") != "error"
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("user_id").cast("string").alias("text")))
    message = F.when(ok, F.struct(F.lit("end_turn").alias("stop_reason"), blocks.alias("content"), F.struct((F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 90).alias("output_tokens")).alias("usage")))
    error = F.when(~ok, F.struct(F.lit("api").alias("type"), F.lit("overloaded").alias("message")))
    result = F.struct(F.when(ok, "succeeded").otherwise("errored").alias("type"), error.alias("error"), message.alias("message"))
    return e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), result.alias("result"))).alias("value"))


@query("""select event_id::varchar as custom_id, case when event_type = 'error' then 'errored' else 'succeeded' end as status, case when event_type <> 'error' then event_type || user_id end as text,
  case when event_type <> 'error' then event_id % 1000 else -1 end as input_tokens, case when event_type = 'error' then 'overloaded' end as error, case when event_type <> 'error' then 'end_turn' end as stop_reason from events""")
def s10_message_results(spark, d):
    r = jsonl.message_results(_message_lines(spark, d))
    return r.select("custom_id", "status", "text", F.coalesce(F.try_element_at("usage", F.lit("input_tokens")), F.lit(-1)).alias("input_tokens"), "error", "stop_reason")


def _chat_lines(spark, d, bad: bool):
    e = table(spark, d, "events").where((F.col("event_type") == "error") == F.lit(bad))
    code = F.when(F.col("event_id") % 2 == 0, 429).otherwise(200) if bad else F.lit(200)
    body_error = F.when(F.col("event_id") % 4 == 1, F.struct(F.lit("bad request").alias("message"))) if bad else F.lit(None).cast("struct<message:string>")
    choices = F.array(F.struct(F.lit("stop").alias("finish_reason"), F.struct(F.col("event_type").alias("content")).alias("message")))
    usage = F.struct((F.col("event_id") % 1000).alias("prompt_tokens"), F.struct((F.col("event_id") % 70).alias("cached_tokens")).alias("prompt_tokens_details"))
    body = F.struct(body_error.alias("error"), choices.alias("choices"), usage.alias("usage"))
    top = F.when(F.col("event_id") % 4 == 3, F.struct(F.lit("expired").alias("message"))) if bad else F.lit(None).cast("struct<message:string>")
    return e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), top.alias("error"), F.struct(code.alias("status_code"), body.alias("body")).alias("response"))).alias("value"))


@query("""select event_id::varchar as custom_id, case when event_type = 'error' then 'errored' else 'succeeded' end as status, case when event_type <> 'error' then event_type end as text,
  event_id % 70 as cached_tokens, case when event_type = 'error' then case event_id % 4 when 3 then 'expired' when 1 then 'bad request' else 'http 429' end end as error from events""")
def s11_chat_results(spark, d):
    r = jsonl.chat_results(_chat_lines(spark, d, False), _chat_lines(spark, d, True))
    return r.select("custom_id", "status", "text", F.try_element_at("usage", F.lit("cached_tokens")).alias("cached_tokens"), "error")


@query("select event_id::varchar as custom_id, 'succeeded' as status, event_type as text, event_id % 1000 as prompt_tokens from events where event_type <> 'error'")
def s12_chat_results_single_file(spark, d):
    r = jsonl.chat_results(_chat_lines(spark, d, False))
    return r.select("custom_id", "status", "text", F.try_element_at("usage", F.lit("prompt_tokens")).alias("prompt_tokens"))


@query("select doc_id, event_type as text, lang from (select event_id, event_type from events where event_type <> 'error') join documents on event_id = doc_id")
def s17_backfill(spark, d):
    r = jsonl.message_results(_message_lines(spark, d)).where("status = 'succeeded'")
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("custom_id"))
    return docs.join(r.select("custom_id", F.regexp_extract("text", "^[a-z_]+", 0).alias("text")), "custom_id").select("doc_id", "text", "lang")


@query(f"select * from {TRUTH} where human is not null")
def s6_labelled_eval(spark, d):
    return jsonl.labelled_eval(truth(spark, d), "human")


# ---- joins -------------------------------------------------------------------------------------
@query("select o_orderkey, c_mktsegment, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where c_acctbal > 9000")
def j1_enrich(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    hit, _ = merge.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")
    return merge.lookup(hit, table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")[0].select("o_orderkey", "c_mktsegment", "n_name")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def j1_failed_lookups(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.lookup(table(spark, d, "orders"), c, "o_custkey")[1].select("o_orderkey")


@query("select l_orderkey, o_orderpriority, sum(l_quantity) as qty from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P' group by 1, 2")
def j2_annotate(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(o, "l_orderkey").groupBy("l_orderkey", "o_orderpriority").agg(F.sum("l_quantity").alias("qty"))


_PATCH = "(select user_id as c_custkey, case when event_type = 'error' then null else value end as c_acctbal, event_type as note, ts, event_id from events)"


def _patches(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") != "error", F.col("value")).alias("c_acctbal"), F.col("event_type").alias("note"), "ts", "event_id")


@query(f"""with l as (select * from (select *, row_number() over (partition by c_custkey order by ts desc, event_id desc) as n from {_PATCH}) where n = 1)
  select c.c_custkey, c.c_name, case when l.n is not null then l.c_acctbal else c.c_acctbal end as c_acctbal, l.note from customer c left join l using (c_custkey)""")
def j9_merge_patches(spark, d):
    return merge.merge_patches(table(spark, d, "customer"), _patches(spark, d), "c_custkey", ["ts", "event_id"]).select("c_custkey", "c_name", "c_acctbal", "note")


@query(f"""select (select count(*) from customer)::bigint as base_rows, (select count(*) from {_PATCH})::bigint as patch_rows,
  (select count(distinct c_custkey) from {_PATCH} join customer using (c_custkey))::bigint as patched, (select count(*) from {_PATCH} p where c_custkey not in (select c_custkey from customer))::bigint as unmatched""")
def j9_merge_counts(spark, d):
    return merge.merge_counts(table(spark, d, "customer"), _patches(spark, d), "c_custkey")


def _run(spark, d, name):
    return wide(spark, d).where(F.col("model") == name).select("pair", F.col("plain").alias("verdict"), F.when(F.col("plain") != "PARSE_FAIL", F.length("plain") + F.col("pair") % (2 if name == "base" else 3)).alias("confidence"))


_RUN = "(select pair, plain as verdict, case when plain <> 'PARSE_FAIL' then length(plain) + pair % {k} end as confidence from {w} where model = '{m}')"


@query(f"""select pair, va, vb, coalesce(ca, -1) as ca, coalesce(cb, -1) as cb, case when va is distinct from vb then 'verdict_flip' when ca is distinct from cb then 'confidence_shift' else 'identical' end as outcome
  from (select pair, verdict as va, confidence as ca from {_RUN.format(k=2, w=WIDE, m='base')}) full join (select pair, verdict as vb, confidence as cb from {_RUN.format(k=3, w=WIDE, m='tuned')}) using (pair)""")
def j10_compare_runs(spark, d):
    return merge.compare_runs(_run(spark, d, "base"), _run(spark, d, "tuned"), "pair").na.fill(-1, ["ca", "cb"])


@query(f"""select pair, base as verdict, tuned as verdict_b, third as verdict_c, case when tuned is null and third is null then null else (not (base = coalesce(tuned, base) and base = coalesce(third, base) and coalesce(tuned, base) = coalesce(third, base)))::varchar end as disagreement from
  (select b.pair, b.plain as base, t.plain as tuned, s.swapped as third from (select * from {WIDE} where model = 'base') b left join (select * from {WIDE} where model = 'tuned') t using (pair) left join (select * from {WIDE} where model = 'base') s using (pair))""")
def j12_cross_check(spark, d):
    w = wide(spark, d)
    base = w.where("model = 'base'").select("pair", F.col("plain").alias("verdict"))
    b = w.where("model = 'tuned'").select("pair", F.col("plain").alias("verdict"))
    c = w.where("model = 'base'").select("pair", F.col("swapped").alias("verdict"))
    return formatting.cross_checked(base, b, c, "pair").withColumn("disagreement", F.col("disagreement").cast("string"))


@query(f"select pair, model, {', '.join(f'max(case when run = {i} then verdict end) as run_{i}' for i in range(5))} from {SAMPLED} group by 1, 2")
def j16_wide_verdicts(spark, d):
    s = sampled(spark, d).withColumn("key", F.struct("pair", "model"))
    w = merge.wide_by(s, "key", F.concat(F.lit("run_"), F.col("run")), "verdict", [f"run_{i}" for i in range(5)])
    return w.select("key.pair", "key.model", *[f"run_{i}" for i in range(5)])


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def j17_semi(spark, d):
    return validation.subset(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")[0]


@query("select doc_id from documents where doc_id not in (select doc_id from labels) and doc_id not in (select user_id from events)")
def j18_pending(spark, d):
    return merge.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), table(spark, d, "events").select(F.col("user_id").alias("doc_id")), key="doc_id")


@query("select n_nationkey, r_regionkey from nation, region where n_regionkey <> r_regionkey")
def j21_worklist(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").select("r_regionkey")
    done = n.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return merge.worklist(n.select("n_nationkey"), r, done, ["n_nationkey", "r_regionkey"])


_Q = "replace(replace(replace({x}, '{f} A', chr(1)), '{f} B', '{f} A'), chr(1), '{f} B')"
_SWAP = lambda x: _Q.format(x=_Q.format(x=x, f="Response"), f="response")
_CLEAN = r"trim(regexp_replace(trim(regexp_replace(reasoning, '(?is)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g')), '(?i)<confidence>\s*\d+\s*</confidence>', '', 'g'))"
_VFLIP = "case verdict when 'A' then 'B' when 'B' then 'A' else 'TIE' end"
_PROMPT = "'<|system|>' || chr(10) || '' || chr(10) || '<|user|>' || chr(10) || '**Question:** ' || question || chr(10) || chr(10) || '**Answer choices:**' || chr(10) || 'A. x' || chr(10) || chr(10) || '**Response A:** ' || case when swap then b else a end || chr(10) || chr(10) || '**Response B:** ' || case when swap then a else b end || chr(10) || chr(10) || '" + text.VERDICT_QUESTION.replace("\n", "' || chr(10) || '") + "' || chr(10) || '<|assistant|>' || chr(10)"


def _target(reasoning, verdict):
    return f"'<reasoning>' || {reasoning} || '</reasoning><verdict>' || {verdict} || '</verdict>'"


@query(f"""select pair_id, swap, sha256({_PROMPT}) as prompt_sha, {_target(f'case when swap then {_SWAP(_CLEAN)} else {_CLEAN} end', f'case when swap then {_VFLIP} else verdict end')} as target
  from (select *, unnest([false, true]) as swap from {DIALOGUE}) where confidence >= 3""")
def j22_sft_rows(spark, d):
    rows = validation.sft_pool(dialogue(spark, d)).withColumn("choices", F.lit("A. x"))
    return formatting.sft_rows(rows).select("pair_id", "swap", F.sha2("prompt", 256).alias("prompt_sha"), "target")


_SYNTH = "('0x' || substr(sha1(pair_id), 1, 8))::bigint % 10 < 7"


@query(f"""select pair_id, swap, case when {_SYNTH} then 'synth' else 'flip' end as source, {_target(f'case when swap then {_SWAP(_CLEAN)} else {_CLEAN} end', f'case when swap then {_VFLIP} else verdict end')} as chosen,
  case when {_SYNTH} then {_target("case when swap then 'made response B' else 'made response A' end", f"case when swap then verdict else {_VFLIP} end")}
       else {_target(f'case when swap then {_SWAP(_CLEAN)} else {_CLEAN} end', f'case when swap then verdict else {_VFLIP} end')} end as rejected
  from (select *, unnest([false, true]) as swap from {DIALOGUE}) where confidence >= 4 and verdict <> 'TIE'""")
def j23_dpo_rows(spark, d):
    rows = validation.dpo_pool(dialogue(spark, d)).withColumn("choices", F.lit("A. x"))
    synth = rows.select("pair_id", F.lit("made response A").alias("reasoning"), text.flip_verdict(F.col("verdict")).alias("verdict"))
    return formatting.dpo_rows(rows, synth).select("pair_id", "swap", "source", "chosen", "rejected")


@query(f"select case when {_SYNTH} then 'synth' else 'flip' end as source, count(*)::bigint as n from {DIALOGUE} where confidence >= 4 and verdict <> 'TIE' group by 1")
def a47_source_counters(spark, d):
    from tallyloom.functions.hashing import is_synth

    rows = validation.dpo_pool(dialogue(spark, d))
    return rows.groupBy(F.when(is_synth(F.col("pair_id")), "synth").otherwise("flip").alias("source")).agg(F.count("*").alias("n"))


@query("select l_orderkey, count(*)::bigint as failures from lineitem where l_returnflag = 'R' and l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A') group by 1 having count(*) >= 2")
def a41_terminal_failures(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return merge.terminal_failures(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "l_orderkey")


_IDS = "case when c_custkey % 3 = 0 then 'x' when c_custkey % 3 = 1 then 'acme' else 'Acme-labs' end || '/' || lower(c_mktsegment) || '-' || c_nationkey || case when c_custkey % 5 = 0 then '-chat' else '' end"
_ASKED = f"""case when s_suppkey % 4 = 0 then 'ACME/' || 'building-' || s_nationkey when s_suppkey % 4 = 1 then 'acme-labs/unknown' when s_suppkey % 4 = 2 then 'machinery-' || s_nationkey
  else 'x/furniture-' || s_nationkey end"""
_RUNS = "list_distinct(list_transform(range(1, greatest(length(%s) - 2, 1) + 1), lambda i: substr(lower(%s), i, 3)))"


@query(f"""with known as (select distinct {_IDS} as id from customer), wanted as (select distinct {_ASKED} as w from supplier), misses as (select w from wanted where w not in (select id from known)),
  m as (select w, id, contains(lower(id), lower(w)) as whole, len(list_intersect({_RUNS % ('w', 'w')}, {_RUNS % ('id', 'id')})) as shared from misses, known
    where contains(lower(id), lower(w)) or contains(id, split_part(w, '/', 1)))
  select w as wanted, id as suggestion, place::int as place from (select *, row_number() over (partition by w order by whole desc, shared desc, id) as place from m) where place <= 10""")
def j25_nearest_match(spark, d):
    known = table(spark, d, "customer").select(F.expr(_IDS).alias("model"))
    wanted = table(spark, d, "supplier").select(F.expr(_ASKED).alias("model"))
    return connectors.nearest(wanted, known, "model")


@query(f"select pair, coalesce(b.plain, '') as base, coalesce(t.plain, '') as tuned from (select * from {WIDE} where model = 'base') b left join (select pair, plain from {WIDE} where model = 'tuned') t using (pair)")
def j26_side_by_side(spark, d):
    w = wide(spark, d)
    t = w.where("model = 'tuned'").select("pair", F.col("plain").alias("t"))
    return w.where("model = 'base'").select("pair", "plain").join(t, "pair", "left").select("pair", F.coalesce("plain", F.lit("")).alias("base"), F.coalesce("t", F.lit("")).alias("tuned"))


# ---- predicates and validation -----------------------------------------------------------------
@query(f"select pair_id, confidence from {DIALOGUE} where confidence >= 3")
def p6_sft_pool(spark, d):
    return validation.sft_pool(dialogue(spark, d)).select("pair_id", "confidence")


@query(f"select pair_id, verdict from {DIALOGUE} where confidence >= 4 and verdict is distinct from 'TIE'")
def p7_dpo_pool(spark, d):
    return validation.dpo_pool(dialogue(spark, d)).select("pair_id", "verdict")


@query("select l_orderkey, l_linenumber, count(*)::bigint as n from lineitem group by 1, 2 having count(*) > 1")
def p13_duplicate_keys(spark, d):
    return validation.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select event_type, count(*)::bigint as n from events where event_type not in ('click', 'view') group by 1")
def p10_unknown_values(spark, d):
    return validation.unknown_values(table(spark, d, "events"), "event_type", ["click", "view"])


@query("select 'doc_id' as \"column\", count(*) - count(doc_id) as missing from labels union all select 'quality', count(*) - count(quality) from labels union all select 'score', count(*) from labels")
def p11_missing_counts(spark, d):
    return validation.missing_counts(table(spark, d, "labels"), ["doc_id", "quality", "score"])


@query("select doc_id, quality from labels where quality not in (1, 2)")
def p12_out_of_domain(spark, d):
    return validation.outside(table(spark, d, "labels"), "quality", [1, 2]).select("doc_id", "quality")


@query("select n_nationkey from nation where n_name <> lower(trim(n_name))")
def p14_unnormalised(spark, d):
    return validation.unnormalised(table(spark, d, "nation"), "n_name").select("n_nationkey")


@query("select (select count(*) from documents)::bigint as keys, (select count(*) from documents where doc_id in (select doc_id from labels) and lang = 'en')::bigint as overlapping, (select count(*) from documents where doc_id not in (select doc_id from labels) and lang <> 'en')::bigint as unassigned")
def p15_split_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return validation.split_report(docs, {"labelled": table(spark, d, "labels"), "english": docs.where("lang = 'en'")}, "doc_id")


@query("select count(*)::bigint as n, count(*) between 100 and 1000000 as ok from documents")
def p16_count_gate(spark, d):
    return validation.count_between(table(spark, d, "documents"), 100, 1000000)


@query("select doc_id from documents where contains(text, 'token') or contains(lang, 'token') or contains(source, 'token')")
def p17_forbidden_token(spark, d):
    return validation.forbidden(table(spark, d, "documents"), "token").select("doc_id")


@query("select doc_id from documents where ends_with(text, '.')")
def p18_suffix(spark, d):
    return table(spark, d, "documents").where(F.endswith("text", F.lit("."))).select("doc_id")


@query(f"select pair, sum((model = 'base')::int)::bigint as base, count(*)::bigint as n from {SAMPLED} where run = 0 group by 1")
def p27_partition_by_pass(spark, d):
    s = sampled(spark, d).select("pair", "model", F.lit(0.3).alias("temperature"), F.lit(False).alias("swapped"), F.col("run").alias("run_index"))
    known, _ = formatting.with_pass(s)
    return known.where("pass = 'consistency_0'").groupBy("pair").agg(F.count_if(F.col("model") == "base").alias("base"), F.count("*").alias("n"))


@query("select r_name, n from (select unnest(['a', 'b']) as r_name, unnest([1, 2]) as n)")
def p28_zipped_targets(spark, d):
    one = table(spark, d, "region").limit(1).select(F.inline(F.arrays_zip(F.array(F.lit("a"), F.lit("b")).alias("r_name"), F.array(F.lit(1), F.lit(2)).alias("n"))))
    return one.toDF("r_name", "n")


@query("select p_partkey, list_filter(list_transform(string_split(p_name || ', ,x', ','), lambda s: trim(s)), lambda s: s <> '')[1] as first from part")
def p23_csv_split(spark, d):
    from tallyloom.functions.rules import normalise_groups

    return table(spark, d, "part").select("p_partkey", F.get(normalise_groups(F.concat("p_name", F.lit(", ,x"))), 0).alias("first"))


@query("select r.route, count(*)::bigint as n from (select case when user_id % 10 = 9 then 'unknown_key' when event_type = 'error' then 'batch_error' when event_id % 3 = 0 then 'ok' when event_id % 3 = 1 then 'refusal' else 'parse_error' end as route from events) r group by 1")
def k8_dead_letter_routes(spark, d):
    e = table(spark, d, "events")
    m = F.col("event_id") % 3
    out = F.when(m == 0, "<reasoning>because</reasoning><verdict>a</verdict><confidence>4</confidence>").when(m == 1, "I'm unable to help.").otherwise("nothing")
    e = e.withColumn("out", out).withColumn("status", F.when(F.col("event_type") == "error", "errored").otherwise("succeeded")).withColumn("stop", F.lit("end_turn"))
    return formatting.routed(e, "out", "status", "stop", F.col("user_id") % 10 != 9).groupBy("route").agg(F.count("*").alias("n"))


@query("select count(*)::bigint as rows from documents")
def k12_table_digest(spark, d):
    return sinks.table_digest(table(spark, d, "documents")).select("rows")


@query(f"select slice, pair, category, null::varchar as human_verdict from {TRUTH}")
def p3_eval_records(spark, d):
    t = truth(spark, d)
    r = lambda x: F.struct(F.lit(x).alias("model"), F.lit("t").alias("text"), F.lit("high").alias("suspected_bias_level"))
    t = t.select("pair", "category", "slice", r("a").alias("response_a"), r("b").alias("response_b"))
    e = formatting.eval_records(t, "x")
    assert "suspected_bias_level" not in e.schema["response_a"].dataType.fieldNames()
    return e.select("slice", "pair", "category", "human_verdict")


@query("select o_orderkey::varchar as question_id, o_orderpriority as category, o_custkey::int as example_id, o_totalprice as price from orders")
def p1_row_constructor(spark, d):
    c = F.col
    return table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("question_id"), c("o_orderpriority").alias("category"), c("o_custkey").cast("int").alias("example_id"), c("o_totalprice").alias("price"))


@query("select s_suppkey, s_name, n_name, n_regionkey from supplier join nation on s_nationkey = n_nationkey")
def p2_copy_dimension_columns(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return merge.lookup(table(spark, d, "supplier"), n, "s_nationkey")[0].select("s_suppkey", "s_name", "n_name", "n_regionkey")


@query("select c_custkey, c_name as model, c_mktsegment as text, n_name as question_text from customer join nation on c_nationkey = n_nationkey")
def p4_nested_records(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = table(spark, d, "customer").join(n, "c_nationkey")
    nested = j.select("c_custkey", F.col("n_name").alias("question_text"), F.struct(F.col("c_name").alias("model"), F.col("c_mktsegment").alias("text")).alias("response_a"))
    return nested.select("c_custkey", "response_a.model", "response_a.text", "question_text")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority in ('1-URGENT', '5-LOW')")
def p5_stratum_cells(spark, d):
    cells = spark.createDataFrame([(p, s) for p in ("1-URGENT", "5-LOW") for s in "FP"], "o_orderpriority string, o_orderstatus string")
    return table(spark, d, "orders").join(cells, ["o_orderpriority", "o_orderstatus"], "left_semi").select("o_orderkey")


@query("select case when ('0x' || substr(sha1(o_orderkey::varchar), 1, 8))::bigint % 10 < 7 then 'synth' else 'flip' end as side, count(*)::bigint as n from orders group by 1")
def p8_hash_bucket_sides(spark, d):
    from tallyloom.functions.hashing import is_synth

    o = table(spark, d, "orders")
    t = is_synth(F.col("o_orderkey").cast("string"))
    side = lambda w, n: o.where(w).agg(F.lit(n).alias("side"), F.count("*").alias("n"))
    return side(t, "synth").unionByName(side(~t, "flip"))


@query("select (lang = 'en') as english, count(*)::bigint as n from documents group by 1")
def p9_partition_by_predicate(spark, d):
    docs = table(spark, d, "documents")
    part = lambda t, v: docs.where(t).agg(F.lit(v).alias("english"), F.count("*").alias("n"))
    return part(F.col("lang") == "en", True).unionByName(part(F.col("lang") != "en", False))


@query("select n_nationkey, n_name from nation")
def p19_drop_if_present(spark, d):
    return table(spark, d, "nation").drop("n_regionkey", "not_there")


@query("select o_orderkey, o_orderstatus from orders order by o_orderkey limit 25")
def p21_first_n(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_orderstatus")


@query(f"select pair_id, verdict, null::varchar as crosscheck_verdict_b from {DIALOGUE}")
def p24_label_stubs(spark, d):
    rows = dialogue(spark, d).select("pair_id", "verdict")
    return formatting.with_stubs(rows, {"verdict": "string", "crosscheck_verdict_b": "string"})


@query(f"""select pair, model, run, 'consistency_' || run as pass, case when verdict = 'PARSE_FAIL' then 'PARSE_FAIL' else verdict end as verdict from {SAMPLED}""")
def p25_prediction_rows(spark, d):
    s = sampled(spark, d)
    raw = F.when(F.col("verdict") == "PARSE_FAIL", "none").otherwise(F.concat(F.lit("<reasoning>r</reasoning><verdict>"), "verdict", F.lit("</verdict>")))
    s = s.select("pair", "model", "run", text.parse_output(raw)["verdict"].alias("verdict"), F.lit(0.3).alias("temperature"), F.lit(False).alias("swapped"), F.col("run").alias("run_index"))
    return formatting.with_pass(s)[0].select("pair", "model", "run", "pass", "verdict")


@query(f"select pair_id, swap, sha256('s' || chr(0) || {_PROMPT.replace(chr(39) + chr(39) + ' || chr(10) || ' + chr(39) + '<|user|>', chr(39) + 's' + chr(39) + ' || chr(10) || ' + chr(39) + '<|user|>')}) as prompt_hash from (select *, unnest([false, true]) as swap from {DIALOGUE})")
def p26_rendered_prompts(spark, d):
    from tallyloom.functions.hashing import prompt_hash

    c = F.col
    r = merge.doubled(dialogue(spark, d))
    user = text.apply_chat(F.lit("s"), text.user_message(c("question"), F.lit("A. x"), c("a"), c("b"), c("swap")))
    return r.select("pair_id", "swap", prompt_hash(F.lit("s"), user).alias("prompt_hash"))


@query("select l_orderkey, l_suppkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000)")
def p29_surviving_models(spark, d):
    alive = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return validation.subset(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), alive, "l_suppkey")[0]


@query(f"select count(*)::bigint as common, sum((b.plain = t.plain)::int)::bigint as same from (select * from {WIDE} where model = 'base') b join (select * from {WIDE} where model = 'tuned') t using (pair)")
def j11_common_ids(spark, d):
    w = wide(spark, d)
    t = w.where("model = 'tuned'").select("pair", F.col("plain").alias("other"))
    return w.where("model = 'base'").join(t, "pair").agg(F.count("*").alias("common"), F.count_if(F.col("plain") == F.col("other")).alias("same"))


@query(f"select h.pair, w.model, h.human, w.plain from {TRUTH} h join {WIDE} w using (pair) where w.plain <> 'PARSE_FAIL'")
def j13_truth_with_predictions(spark, d):
    p = wide(spark, d).select("pair", "model", "plain").where("plain <> 'PARSE_FAIL'")
    return truth(spark, d).select("pair", "human").join(p, "pair").select("pair", "model", "human", "plain")


@query(f"select pair, plain, swapped, human from {WIDE} where model = 'base' and plain <> 'PARSE_FAIL' and swapped <> 'PARSE_FAIL'")
def j14_three_way_join(spark, d):
    w = wide(spark, d).where("model = 'base'")
    long = w.select("pair", F.explode(F.array(F.struct(F.lit("plain").alias("p"), F.col("plain").alias("v")), F.struct(F.lit("swapped").alias("p"), F.col("swapped").alias("v")))).alias("x")).select("pair", "x.p", "x.v")
    both = merge.wide_by(long, "pair", F.col("p"), "v", ["plain", "swapped"])
    return both.where("plain <> 'PARSE_FAIL' and swapped <> 'PARSE_FAIL'").join(truth(spark, d).select("pair", "human"), "pair").select("pair", "plain", "swapped", "human")


@query(f"select pair, model, count(distinct verdict)::bigint as verdicts, count(*)::bigint as runs from {SAMPLED} group by 1, 2")
def j15_runs_by_key(spark, d):
    return sampled(spark, d).groupBy("pair", "model").agg(F.count_distinct("verdict").alias("verdicts"), F.count("*").alias("runs"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def j19_not_in_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")


@query("select doc_id, lang from documents where doc_id in (select event_id from events where event_type = 'error')")
def j24_retry_set(spark, d):
    bad = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("doc_id"))
    return validation.subset(table(spark, d, "documents").select("doc_id", "lang"), bad, "doc_id")[0]


@query("select local, case when local in ('documents', 'labels') then 'present' else 'missing' end as state from (select unnest(['documents', 'labels', 'nothing']) as local)")
def k17_publish_manifest(spark, d):
    m = sinks.manifest(spark, d, {f"{n}.parquet": n for n in ("documents", "labels", "nothing")})
    return m.select(F.regexp_replace("local", r"\.parquet$", "").alias("local"), "state")


@query("select 'k' || (event_id % 3) as phase, arg_max(event_type, event_id) as status, max(event_id) as batch from events group by 1")
def k14_state_upserts(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id") % 3).alias("phase"), F.col("event_type").alias("status"), F.col("event_id").alias("batch"))
    return merge.last_write(e, ["phase"], ["batch"])


# ---- sets --------------------------------------------------------------------------------------
@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def u2_union_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("select c_custkey as k from customer intersect select s_suppkey from supplier")
def u3_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "supplier").select("s_suppkey"))


@query("select c_custkey as k from customer except select user_id from events")
def u4_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "events").select("user_id").distinct())


@query("select doc_id as k, 'd' as t from documents union all select doc_id, 'l' from labels")
def u1_union_all(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.lit("d").alias("t"))
    return a.unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("k"), F.lit("l").alias("t")))


@query("select count(*) = 0 as disjoint from (select doc_id from labels intersect select doc_id from documents)")
def u5_disjoint(spark, d):
    j = table(spark, d, "labels").select("doc_id").intersect(table(spark, d, "documents").select("doc_id"))
    return j.agg((F.count("*") == 0).alias("disjoint"))


@query("select distinct source from documents")
def u6_distinct_values(spark, d):
    return table(spark, d, "documents").select("source").distinct()


@query(f"select human as value, count(*)::bigint as n from {TRUTH} group by 1")
def a24_outcome_counters(spark, d):
    return metrics.histogram(truth(spark, d), "human", ["A", "B", "TIE"])
