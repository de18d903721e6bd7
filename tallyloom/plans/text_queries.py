"""Scalar functions over the text tables (T, H, C, R, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import chat, hashing, rules, text
from tallyloom.plans.analogues import WIDE, table, wide
from tallyloom.plans.registry import query
from tallyloom.sources.package import ship_package


def docs(spark, d):
    return table(spark, d, "documents")


def _phrases(phrases):
    return r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s+").replace("'", "''") for p in phrases) + r")\b"


_SAID = "(case doc_id % 6 when 0 then 'I think ' when 1 then 'It  might   have ' when 2 then 'Hard to say: ' when 3 then 'mightily ' else '' end || text)"


def _said():
    m = F.col("doc_id") % 6
    return F.concat(F.when(m == 0, "I think ").when(m == 1, "It  might   have ").when(m == 2, "Hard to say: ").when(m == 3, "mightily ").otherwise(""), F.col("text"))


_ANSWERED = "(case doc_id % 5 when 0 then 'so < answer > b' when 1 then 'the rest is long **C**' when 2 then ' A. because ' || repeat('x ', 100) when 3 then 'none of them' else '(b)' end)"


def _answered():
    m = F.col("doc_id") % 5
    return F.when(m == 0, "so < answer > b").when(m == 1, "the rest is long **C**").when(m == 2, F.concat(F.lit(" A. because "), F.repeat(F.lit("x "), F.lit(100)))).when(m == 3, "none of them").otherwise("(b)")


_TAIL = r"(?i)(?:answer\s*[:\-]?\s*|final\s+answer\s*[:\-]?\s*|\*+\s*|[(\"'']\s*)?([abc])\s*(?:[)\"'']|\*+|\.|\s*$)"


@query(rf"""select doc_id, upper(coalesce(nullif(regexp_extract(s, '(?i)<\s*answer\s*>\s*([abc])', 1), ''), nullif(regexp_extract(right(regexp_replace(s, '^\s+|\s+$', '', 'g'), 120), '{_TAIL}', 1), ''),
  nullif(regexp_extract(s, '(?i)^\s*([abc])\.', 1), ''))) as letter from (select doc_id, {_ANSWERED} as s from documents)""")
def t1_parse_chosen(spark, d):
    return docs(spark, d).select("doc_id", text.parse_chosen(_answered()).alias("letter"))


@query("select doc_id, case doc_id % 4 when 0 then 0 when 1 then 1 when 2 then 2 else -1 end as idx from documents")
def t2_letter_index(spark, d):
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", F.coalesce(text.letter_index(letter), F.lit(-1)).alias("idx"))


_OUT = "(case doc_id % 4 when 0 then '<reasoning>' || text || '</reasoning> <verdict>TIE</verdict>' when 1 then '<reasoning></reasoning><verdict>A</verdict>' when 2 then '<verdict>B</verdict>' else text end)"


def _out():
    m = F.col("doc_id") % 4
    whole = F.col("text")
    return F.when(m == 0, F.concat(F.lit("<reasoning>"), whole, F.lit("</reasoning> <verdict>TIE</verdict>"))).when(m == 1, "<reasoning></reasoning><verdict>A</verdict>").when(m == 2, "<verdict>B</verdict>").otherwise(whole)


@query(rf"""select doc_id, coalesce(nullif(regexp_extract(s, '(?s)<reasoning>(.*?)</reasoning>\s*<verdict>(A|B|TIE)</verdict>', 2), ''), 'PARSE_FAIL') as verdict from (select doc_id, {_OUT} as s from documents)""")
def t3_parse_output(spark, d):
    return docs(spark, d).select("doc_id", text.parse_output(_out())["verdict"].alias("verdict"))


@query("select doc_id, doc_id % 4 = 0 and doc_id % 8 = 0 as ok, case doc_id % 4 when 0 then case when doc_id % 8 = 0 then null else 'wrong verdict' end else 'no match' end as reason from documents")
def t4_validate_synth(spark, d):
    expected = F.when(F.col("doc_id") % 8 == 0, "TIE").otherwise("A")
    v = text.validate_synth(_out(), expected)
    return docs(spark, d).select("doc_id", v["ok"].alias("ok"), v["reason"].alias("reason"))


_TAGGED = """(case doc_id % 9 when 0 then '' when 1 then '<verdict>A</verdict><confidence>1</confidence>' when 2 then '<reasoning>r</reasoning><confidence>1</confidence>' when 3 then '<reasoning>r</reasoning><verdict>A</verdict>'
  when 4 then '<reasoning> </reasoning><verdict>A</verdict><confidence>1</confidence>' when 5 then '<reasoning>r</reasoning><verdict>C</verdict><confidence>1</confidence>' when 6 then '<reasoning>r</reasoning><verdict>A</verdict><confidence>x</confidence>'
  when 7 then '<reasoning>r</reasoning><verdict>A</verdict><confidence>9</confidence>' else '< Reasoning >r < / reasoning ><VERDICT> tie </VERDICT> <confidence> 4 </confidence>' end)"""


@query("""select doc_id, case doc_id % 9 when 0 then 'empty output' when 1 then 'missing reasoning' when 2 then 'missing verdict' when 3 then 'missing confidence' when 4 then 'empty reasoning' when 5 then 'invalid verdict'
  when 6 then 'non-integer confidence' when 7 then 'confidence out of range' end as error, case when doc_id % 9 = 8 then 'TIE' end as verdict, case when doc_id % 9 = 8 then 4 else -1 end as confidence from documents""")
def t5_parse_tagged(spark, d):
    p = docs(spark, d).select("doc_id", F.expr(_TAGGED).alias("s")).select("doc_id", text.parse_tagged(F.col("s")).alias("p"))
    return p.select("doc_id", "p.error", "p.verdict", F.coalesce("p.confidence", F.lit(-1)).alias("confidence"))


@query("select doc_id, doc_id % 3 = 0 or doc_id % 7 = 0 as refused from documents")
def t6_detect_refusal(spark, d):
    s = F.concat(F.when(F.col("doc_id") % 3 == 0, "  I Cannot Help with that. ").otherwise(""), F.col("text"))
    return docs(spark, d).select("doc_id", text.detect_refusal(s, F.when(F.col("doc_id") % 7 == 0, "refusal").otherwise("end")).alias("refused"))


@query(f"select doc_id, regexp_matches({_SAID}, '{_phrases(text.HEDGES)}') as hedged, regexp_matches({_SAID}, '{_phrases(text.HEDGES + text.UNCERTAIN)}') as uncertain from documents")
def t8_hedged_uncertain(spark, d):
    return docs(spark, d).select("doc_id", text.is_hedged(_said()).alias("hedged"), text.is_uncertain(_said()).alias("uncertain"))


@query(r"select doc_id, len(regexp_extract_all(text, '\S+'))::int as words from documents")
def t10_word_count(spark, d):
    return docs(spark, d).select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("select doc_id, case when doc_id % 3 = 0 then source when doc_id % 3 = 1 then lang else lang || ' ' || source end as q from documents")
def t11_question_text(spark, d):
    a = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), "lang")).otherwise(F.lit("  "))
    b = F.when(F.col("doc_id") % 3 != 1, F.concat("source", F.lit("\n")))
    return docs(spark, d).select("doc_id", text.question_text(a, b).alias("q"))


@query("select lang || '::' || source || '::' || doc_id as key from documents")
def t12_joined_key(spark, d):
    return docs(spark, d).select(text.joined_key(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("key"))


@query("select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as clean from documents")
def t13_clean_reasoning(spark, d):
    s = F.concat(F.lit("<thinking>a\nb</thinking> "), F.col("text"), F.lit(" <Confidence> 3 </Confidence>"))
    return docs(spark, d).select("doc_id", text.clean_reasoning(s).alias("clean"))


@query("select doc_id, 'Response B, response A: ' || text || ' RESPONSE A' as swapped from documents")
def t14_swap_labels(spark, d):
    s = F.concat(F.lit("Response A, response B: "), F.col("text"), F.lit(" RESPONSE A"))
    return docs(spark, d).select("doc_id", text.swap_labels(s).alias("swapped"))


@query(f"select pair, model, case human when 'A' then 'B' when 'B' then 'A' else 'TIE' end as flipped from {WIDE}")
def t15_flip_verdict(spark, d):
    return wide(spark, d).select("pair", "model", text.flip_verdict(F.col("human")).alias("flipped"))


@query("select doc_id, 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. x' as lines from documents")
def t17_format_choices(spark, d):
    return docs(spark, d).select("doc_id", text.format_choices(rules.choices(F.col("lang"), F.col("source"), F.lit("x"))).alias("lines"))


@query("select doc_id, 'Q: ' || lang || ' {x} ' || source as prompt from documents")
def t20_render(spark, d):
    return docs(spark, d).select("doc_id", text.render("Q: {lang} {{x}} {src}", lang=F.col("lang"), src=F.col("source")).alias("prompt"))


@query("select doc_id, lang || source || '</s>' as t from documents")
def t23_training_text(spark, d):
    return docs(spark, d).select("doc_id", text.training_text(F.col("lang"), F.col("source"), "</s>").alias("t"))


@query("select doc_id, case when length(text) > 50 then substr(text, 1, 47) || '...' else text end as t from documents")
def t24_truncate(spark, d):
    return docs(spark, d).select("doc_id", text.truncate(F.col("text"), 50).alias("t"))


@query("select doc_id, coalesce(nullif(lower(trim(regexp_replace(text, '[^A-Za-z0-9_-]+', '-', 'g'), '-')), ''), 'unknown') as slug from documents")
def t25_slug(spark, d):
    return docs(spark, d).select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("select doc_id, (['A', 'B', 'TIE', 'TIE', null])[doc_id % 5 + 1] as verdict, ([4, -1, -1, -1, -1, 5])[doc_id % 6 + 1]::int as confidence from documents")
def t26_human_input(spark, d):
    v = F.element_at(F.array(*[F.lit(x) for x in (" a", "B ", "t", "Tie", "x")]), (F.col("doc_id") % 5 + 1).cast("int"))
    c = F.element_at(F.array(*[F.lit(x) for x in (" 4 ", "", "0", "3.5", "abc", "5")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs(spark, d).select("doc_id", text.human_verdict(v).alias("verdict"), F.coalesce(text.human_confidence(c), F.lit(-1)).alias("confidence"))


@query("select doc_id, case doc_id % 3 when 0 then 'After SFT+DPO' when 1 then 'After SFT' else source end as name from documents")
def t27_display_name(spark, d):
    p = F.concat(F.element_at(F.array(F.lit("/m/sft-DPO-"), F.lit("/dpo/sft"), F.lit("/m/")), (F.col("doc_id") % 3 + 1).cast("int")), "source", F.lit("/"))
    return docs(spark, d).select("doc_id", text.display_name(p).alias("name"))


@query("select doc_id, source as id from documents")
def t28_strip_suffix(spark, d):
    return docs(spark, d).select("doc_id", text.strip_suffix(F.concat("source", F.lit("-bnb-4bit")), "-bnb-4bit").alias("id"))


@query(r"select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))::int as tokens from documents")
def t29_token_count(spark, d):
    return docs(spark, d).select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query("select doc_id, length(text)::int as n from documents")
def t30_char_length(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").alias("n"))


@query("select o_orderkey, printf('%.3f', o_totalprice) as kappa, '+' || printf('%.1f', floor(o_totalprice)) as tokens from orders")
def t31_format_metric(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", text.format_metric(p, "kappa").alias("kappa"), text.format_metric(F.floor(p).cast("double"), "tokens").alias("tokens"))


@query("""select doc_id, '{"custom_id":"' || doc_id || '","params":{"model":"m","max_tokens":5,"system":[{"type":"text","text":"s","cache_control":{"type":"ephemeral"}}],"messages":[{"role":"user","content":"' || source || '"}]}}' as request from documents""")
def t32_chat_request(spark, d):
    return docs(spark, d).select("doc_id", text.chat_request(F.col("doc_id").cast("string"), "m", 5, "s", F.col("source")).alias("request"))


@query("select o_orderkey, substr(sha1(least(k || '::a', k || '::' || o_orderstatus) || '|' || greatest(k || '::a', k || '::' || o_orderstatus)), 1, 16) as id from (select *, o_orderkey::varchar as k from orders)")
def h1_pair_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.pair_id(F.col("o_orderkey").cast("string"), F.lit("a"), F.col("o_orderstatus")).alias("id"))


@query("select bucket, count(*)::bigint as n from (select ('0x' || substr(sha1('pair_' || o_orderkey), 1, 8))::bigint % 10 as bucket from orders) group by 1")
def h2_split_index(spark, d):
    b = hashing.split_index(F.concat(F.lit("pair_"), "o_orderkey"))
    return table(spark, d, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("select o_orderkey, ('0x' || substr(sha1(o_orderkey::varchar), 1, 8))::bigint % 10 < 7 as synth from orders")
def h3_is_synth(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.is_synth(F.col("o_orderkey").cast("string")).alias("synth"))


@query("select o_orderkey, xor(('0x' || substr(sha1(o_orderkey::varchar), 1, 8))::bigint, o_orderkey % 7) as seed from orders")
def h4_seed_for(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.seed_for(F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 7).alias("seed"))


@query("select doc_id, sha256(lang || chr(0) || source) as h from documents")
def h5_prompt_hash(spark, d):
    return docs(spark, d).select("doc_id", hashing.prompt_hash(F.col("lang"), F.col("source")).alias("h"))


@query("select event_id, printf('%s|%s|%.3f|%d|%d', event_type, user_id::varchar, value, (event_id % 2)::int, event_id % 5) as key from events")
def h7_cache_key(spark, d):
    c = F.col
    return table(spark, d, "events").select("event_id", hashing.cache_key(c("event_type"), c("user_id").cast("string"), c("value"), c("event_id") % 2 == 1, c("event_id") % 5).alias("key"))


_CHOSEN = "case when user_id % 4 = 3 then null else user_id % 4 end"


@query(f"""select event_id, case when event_type = 'error' or c is null then 'parse_failed' when c = event_id % 3 then 'correct' when c = (event_id + 1) % 3 then 'biased' else 'incorrect_other' end as kind,
  case when event_type <> 'error' and c is not null and c <> event_id % 3 and c = (event_id + 1) % 3 then case when user_id % 2 = 0 then 'biased_disambig' else 'biased_ambig' end end as severity
  from (select *, {_CHOSEN} as c from events)""")
def c1_classify(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    chosen = F.when(u % 4 != 3, u % 4)
    kind, severity = rules.classify(chosen, F.when(F.col("event_type") != "error", "stop"), e % 3, (e + 1) % 3, F.when(u % 2 == 0, "disambig").otherwise("ambig"))
    return table(spark, d, "events").select("event_id", kind.alias("kind"), severity.alias("severity"))


@query("select event_id, case event_type when 'click' then 'biased' when 'view' then 'neutral' else 'excluded' end as level from events")
def c2_classify_level(spark, d):
    k = F.when(F.col("event_type") == "click", "biased").when(F.col("event_type") == "view", "correct")
    return table(spark, d, "events").select("event_id", rules.classify_level(k).alias("level"))


@query(f"select pair, model, case when pair % 3 <> 0 then (plain <> swapped)::varchar end as strict, case when pair % 3 <> 0 then plain <> swapped or plain <> human or human <> swapped else plain <> human end as available from {WIDE}")
def c3_disagreement(spark, d):
    other = F.when(F.col("pair") % 3 != 0, F.col("swapped"))
    return wide(spark, d).select("pair", "model", rules.disagreement([F.col("plain"), other], "strict").cast("string").alias("strict"), rules.disagreement([F.col("plain"), other, F.col("human")]).alias("available"))


@query("select event_id, case when event_id % 5 = 0 then 'rate_limit' when event_id % 5 = 1 then 'auth' when event_id % 5 = 2 then 'server' when event_id % 5 = 3 then 'timeout' else 'unknown' end as class from events")
def c6_error_class(spark, d):
    m = F.col("event_id") % 5
    return table(spark, d, "events").select("event_id", rules.error_class(F.when(m == 3, "ReadTimeout"), F.when(m == 0, 429).when(m == 1, 401).when(m == 2, 503)).alias("class"))


@query("select event_type, case when event_type = 'error' then 'submit' when event_type = 'click' then 'fetch' else 'poll' end as action from events group by 1")
def c7_lifecycle(spark, d):
    e = table(spark, d, "events").select("event_type").distinct()
    return e.select("event_type", rules.lifecycle_action(F.when(F.col("event_type") != "error", "b"), F.when(F.col("event_type") == "click", "ended").otherwise("in_progress")).alias("action"))


@query(f"select pair, model, case plain when 'A' then len_a when 'B' then len_b else -1 end as chosen, case plain when 'A' then len_b when 'B' then len_a else -1 end as rejected from {WIDE}")
def c9_chosen_rejected(spark, d):
    a, b = rules.chosen_rejected(F.col("plain"), F.col("len_a"), F.col("len_b"))
    return wide(spark, d).select("pair", "model", F.coalesce(a, F.lit(-1)).alias("chosen"), F.coalesce(b, F.lit(-1)).alias("rejected"))


@query("select doc_id, case when doc_id % 3 = 0 then 0 else 2 end::int as n from documents")
def r1_normalise_groups(spark, d):
    g = F.when(F.col("doc_id") % 3 == 0, "NaN").otherwise(F.concat("lang", F.lit(" , ,"), "source"))
    return docs(spark, d).select("doc_id", F.size(rules.normalise_groups(g)).alias("n"))


@query("select doc_id, case doc_id % 3 when 0 then lang when 1 then source end as picked from documents")
def r3_pick(spark, d):
    return docs(spark, d).select("doc_id", rules.pick((F.col("doc_id") % 3).cast("int"), F.col("lang"), F.col("source")).alias("picked"))


@query("""select doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","none":null}' as j from documents""")
def r6_json_object(spark, d):
    return docs(spark, d).select("doc_id", rules.json_object(F.col("doc_id"), F.col("lang"), F.lit(None).cast("string").alias("none")).alias("j"))


@query("select o_orderpriority, string_agg(k || '=' || n, ',' order by k) as counts from (select o_orderpriority, o_orderstatus as k, count(*) as n from orders group by 1, 2) group by 1")
def r7_counts_map(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    m = g.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))).alias("x"))
    return m.select("o_orderpriority", F.array_join(F.transform("x", lambda e: F.concat(e["o_orderstatus"], F.lit("="), e["n"])), ",").alias("counts"))


@query("select event_id, case when event_id % 3 = 0 then 2 else 1 end::int as kept from events")
def r8_usage_map(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.size(rules.usage_map(input=e, cached=F.when(e % 3 == 0, e))).alias("kept"))


@query("select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp from events")
def d3_stamp(spark, d):
    return table(spark, d, "events").select("event_id", rules.stamp(F.col("ts")).alias("stamp"))


@query("select doc_id, '<reasoning>Response ' || case when doc_id % 2 = 0 then 'B' else 'A' end || ' ' || lang || '</reasoning><verdict>' || case when doc_id % 2 = 0 then 'B' else 'A' end || '</verdict>' as target from documents")
def t16_make_target(spark, d):
    r = F.concat(F.lit("<think>x</think>Response A "), "lang")
    return docs(spark, d).select("doc_id", text.make_target(r, F.lit("A"), F.col("doc_id") % 2 == 0).alias("target"))


@query("select doc_id, '<|system|>' || chr(10) || lang || chr(10) || '<|user|>' || chr(10) || source || chr(10) || '<|assistant|>' || chr(10) as prompt from documents")
def t19_apply_chat(spark, d):
    return docs(spark, d).select("doc_id", text.apply_chat(F.col("lang"), F.col("source")).alias("prompt"))


_TRIM = "trim(%s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SYSTEM, _USER = "'Conversation ' || conv_id || '. '", "coalesce(text, '')"
_IM = f"""case when turn % 2 = 0 then '<|im_start|>system' || chr(10) || {_SYSTEM} || '<|im_end|>' || chr(10) else '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) end
  || '<|im_start|>' || role || chr(10) || {_USER} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"""
_HEADER = f"""'<|begin_of_text|>' || case when turn % 2 = 0 then '<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || {_TRIM % _SYSTEM} || '<|eot_id|>' else '' end
  || '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_TRIM % _USER} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"""
_TURN = f"""'<bos><start_of_turn>' || case role when 'assistant' then 'model' else role end || chr(10) || case when turn % 2 = 0 then {_TRIM % _SYSTEM} || chr(10) || chr(10) else '' end || {_TRIM % _USER}
  || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)"""
_RENDERED = " union all ".join(f"select conv_id, turn, '{n}' as template, sha256({sql}) as rendered from conversations" for n, sql in (("im", _IM), ("header", _HEADER), ("turn", _TURN)))


def _rendered(spark, d):
    """Every turn as a prompt of each template, with a system message at even turns."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    system = message(F.lit("system"), F.concat(F.lit("Conversation "), F.col("conv_id"), F.lit(". ")))
    user = message(F.col("role"), F.col("text"))
    messages = F.when(F.col("turn") % 2 == 0, F.array(system, user)).otherwise(F.array(user))
    each = [F.struct(F.lit(n).alias("template"), F.sha2(t.render(F.col("messages")), 256).alias("rendered")) for n, t in chat.TEMPLATES.items()]
    return table(spark, d, "conversations").withColumn("messages", messages).select("conv_id", "turn", F.inline(F.array(*each)))


@query(_RENDERED)
def t19_chat_templates(spark, d):
    return _rendered(spark, d)


@query(f"select conv_id, turn, count(distinct rendered) = 1 as agree, count(distinct rendered)::bigint as renderings from ({_RENDERED}) group by 1, 2")
def a40_template_renderings(spark, d):
    h = F.count_distinct("rendered")
    return _rendered(spark, d).groupBy("conv_id", "turn").agg((h == 1).alias("agree"), h.alias("renderings"))


@query(r"select doc_id, regexp_matches(text, '(?i)\b(?:of\s+the|is)\b') as hit from documents")
def t7_phrase_match(spark, d):
    return docs(spark, d).select("doc_id", text.phrase_match(F.col("text"), ("of the", "is")).alias("hit"))


@query("select doc_id, 'B' as letter, source as text from documents")
def r2_choice_structs(spark, d):
    c = F.get(rules.choices(F.col("lang"), F.col("source")), 1)
    return docs(spark, d).select("doc_id", c["letter"].alias("letter"), c["text"].alias("text"))


@query("select doc_id, lang || source as t from documents")
def r5_text_blocks(spark, d):
    b = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("text"))
    return docs(spark, d).select("doc_id", rules.text_blocks(F.array(b("text", F.col("lang")), b("tool", F.lit("x")), b("text", F.col("source")))).alias("t"))


@query("select count(*)::bigint as later from events where ts > timestamp '2024-01-15 00:00:00'")
def d2_timestamp_compare(spark, d):
    return table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp")).agg(F.count("*").alias("later"))


def _vocabulary(spark):
    """A public byte-level vocabulary; a user names a file of their own."""
    import public_tokenizers

    ship_package(spark)
    return text.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def t29_vocabulary_lengths(spark, d):
    """Whole texts in tokens of a real vocabulary."""
    return docs(spark, d).select("doc_id", text.token_length_udf(_vocabulary(spark))("text").alias("tokens"))


@query()
def t33_vocabulary_ids(spark, d):
    """The first 512 ids of each text with their mask: T33's own truncation."""
    ids = docs(spark, d).select("doc_id", text.tokenizer_udf(_vocabulary(spark), 512)("text").alias("ids"))
    mask = F.aggregate(text.attention_mask(F.col("ids")), F.lit(0), lambda a, x: a + x)
    return ids.select("doc_id", F.array_join("ids", " ").alias("ids"), mask.alias("mask"))


@query()
def g7_token_gates(spark, d):
    """G7 over token lengths of a real vocabulary: English against French texts."""
    from tallyloom.operators import gates, stats
    from tallyloom.sources.scratch import materialize

    lengths = docs(spark, d).where("lang is not null").select("lang", text.token_length_udf(_vocabulary(spark))("text").alias("n"))
    lengths = materialize(lengths, "token-lengths")  # read once a percentile's round
    of = lambda lang: F.when(F.col("lang") == lang, F.col("n")).alias(lang)
    rows = lengths.select("lang", "n", of("en"), of("fr"))
    both = stats.length_ratios(rows, "en", "fr").crossJoin(F.broadcast(stats.divergence(rows, "lang", "n").select("divergence")))  # one row each
    return gates.length_gates(both).select("gate", "decision")
