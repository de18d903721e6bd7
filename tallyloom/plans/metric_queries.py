"""Metrics, statistics, gates and ledgers (A, G, W12-W13, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import cost
from tallyloom.operators import gates, ledger, metrics, stats
from tallyloom.operators.formatting import PASSES
from tallyloom.plans.analogues import SAMPLED, TRUTH, WIDE, sampled, sql_kappa, table, truth, wide
from tallyloom.plans.registry import query

OK = "('A', 'B', 'TIE')"
MOVED = f"plain in {OK} and swapped in {OK} and case plain when 'A' then 'B' when 'B' then 'A' else 'TIE' end <> swapped"
BOTH = f"plain in {OK} and swapped in {OK}"


def _kappa(by, where="true"):
    k = f"round({sql_kappa('human', 'plain')}, 9) as kappa, coalesce(sum((human in {OK} and plain in {OK})::int), 0)::bigint as n"
    return f"select {', '.join(by)}{', ' if by else ''}{k} from {WIDE} where {where} {'group by ' + ', '.join(by) if by else ''}"


@query(_kappa([]))
def a10_cohen_kappa(spark, d):
    return metrics.kappa_by(wide(spark, d), [], "human", "plain")


@query(_kappa(["model", "slice"]))
def a11_kappa_by_slice(spark, d):
    return metrics.kappa_by(wide(spark, d), ["model", "slice"], "human", "plain")


@query(_kappa(["model", "category"], "slice = 'in_distribution'"))
def a12_kappa_by_category(spark, d):
    return metrics.kappa_by(wide(spark, d).where("slice = 'in_distribution'"), ["model", "category"], "human", "plain")


@query(f"select model, slice, round(sum(({MOVED})::int) / nullif(sum(({BOTH})::int), 0), 9) as position_bias, sum(({BOTH})::int)::bigint as n from {WIDE} group by 1, 2")
def a13_position_bias(spark, d):
    return metrics.position_bias(wide(spark, d), ["model", "slice"])


_D = "case plain when 'A' then len_a - len_b when 'B' then len_b - len_a end"


@query(f"select model, round(avg({_D}), 9) as verbosity_bias, count({_D})::bigint as n from {WIDE} group by 1")
def a14_verbosity_bias(spark, d):
    return metrics.verbosity_bias(wide(spark, d), ["model"], "plain", "len_a", "len_b")


_EACH = f"(select model, pair, count(*) as c, sum((verdict = 'PARSE_FAIL')::int) as bad, count(distinct verdict) as v from {SAMPLED} group by 1, 2)"


@query(f"select model, round(sum((c >= 5 and bad = 0 and v = 1)::int) / nullif(sum((c >= 5 and bad = 0)::int), 0), 9) as self_consistency, sum((c >= 5 and bad = 0)::int)::bigint as n from {_EACH} group by 1")
def a15_self_consistency(spark, d):
    return metrics.self_consistency(sampled(spark, d), ["model"], "pair", "verdict", 5)


@query(f"select model, round(avg((verdict = 'PARSE_FAIL')::int), 9) as failure_rate, count(*)::bigint as n from {SAMPLED} group by 1")
def a16_parse_failure_rate(spark, d):
    return metrics.failure_rate(sampled(spark, d), ["model"])


def _scorecard_sql():
    ind, out = "slice = 'in_distribution'", "slice <> 'in_distribution'"
    named = {"kappa_in_distribution": sql_kappa("human", "plain", ind), "kappa_held_out": sql_kappa("human", "plain", out)}
    named |= {f"kappa_{c}": sql_kappa("human", "plain", f"{ind} and category = '{c}'") for c in ("clear", "subtle", "tracked", "tie")}
    bias = lambda t: f"sum(({MOVED} and {t})::int) / nullif(sum(({BOTH} and {t})::int), 0)"
    named |= {"position_bias_in_distribution": bias(ind), "position_bias_held_out": bias(out), "verbosity_bias": f"avg({_D})"}
    one = ", ".join(f"{v} as {k}" for k, v in named.items())
    cols = ", ".join([*named, "self_consistency", "parse_failure"])
    return f"""with w as materialized (select * from {WIDE}), s as materialized (select * from {SAMPLED}),
      one as (select model, {one}, sum((plain = 'PARSE_FAIL')::int + (swapped = 'PARSE_FAIL')::int) as bad, 2 * count(*) as n from w group by 1),
      two as (select model, sum((verdict = 'PARSE_FAIL')::int) as bad2, count(*) as n2 from s group by 1),
      e as (select model, pair, count(*) as c, sum((verdict = 'PARSE_FAIL')::int) as bad, count(distinct verdict) as v from s group by 1, 2),
      c as (select model, sum((c >= 5 and bad = 0 and v = 1)::int) / nullif(sum((c >= 5 and bad = 0)::int), 0) as self_consistency from e group by 1),
      r as (select *, (bad + bad2) / (n + n2) as parse_failure from one join two using (model) join c using (model))
      select model, metric, round(value, 9) as value from (unpivot (select model, {cols} from r) on {cols} into name metric value value)"""


@query(_scorecard_sql())
def a17_scorecard(spark, d):
    return metrics.scorecard(wide(spark, d), sampled(spark, d), "model", 5)


@query(f"""select model, sum(least(n, 1))::bigint as done, count(*)::bigint as keys from (select model, pair, run, count(*) as n from {SAMPLED} where verdict <> 'PARSE_FAIL' group by 1, 2, 3) group by 1""")
def a18_cache_completeness(spark, d):
    g = sampled(spark, d).where("verdict <> 'PARSE_FAIL'").groupBy("model", "pair", "run").agg(F.count("*").alias("n"))
    return g.groupBy("model").agg(F.sum(F.least("n", F.lit(1))).cast("long").alias("done"), F.count("*").alias("keys"))


@query(f"select model, string_agg(pair::varchar, ',' order by pair) as failed from (select distinct model, pair from {SAMPLED} where verdict = 'PARSE_FAIL') group by 1")
def a19_failed_ids(spark, d):
    g = sampled(spark, d).where("verdict = 'PARSE_FAIL'").groupBy("model").agg(F.array_sort(F.collect_set("pair")).alias("ids"))
    return g.select("model", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("failed"))


_FLAGS = ["A", "N", "R"]


@query(f"""select coalesce(l_linestatus, 'all') as l_linestatus, {', '.join(f"sum((l_returnflag = '{f}')::int)::bigint as {f}" for f in _FLAGS)}, count(*)::bigint as total
  from lineitem group by rollup (l_linestatus)""")
def a1_crosstab(spark, d):
    return metrics.crosstab(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", _FLAGS)


@query("""with x as (select o_orderpriority as g, (o_orderstatus = case when o_custkey % 3 = 0 then 'F' when o_custkey % 3 = 1 then 'O' else 'P' end) as s from orders),
  r as (select 'overall' as grain, s from x union all select 'group:' || g, s from x union all select 'hard', s from x where g in ('1-URGENT', '2-HIGH'))
  select grain, sum(s::int)::bigint as matches, count(*)::bigint as total, round(avg(s::int), 9) as rate from r group by 1""")
def a2_agreement_grains(spark, d):
    other = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return metrics.agreement(table(spark, d, "orders").withColumn("other", other), "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderstatus", "other")


@query(f"""select v as value, (select count(*) from {TRUTH} where confidence::varchar = v)::bigint as n from (select unnest(['1', '2', '3', '4', '5', '6']) as v)""")
def a3_zero_filled_histogram(spark, d):
    return metrics.histogram(truth(spark, d), "confidence", [1, 2, 3, 4, 5, 6])


@query("select coalesce(nullif(props::json ->> '$.k', '5'), 'parse_fail') as letter, count(*)::bigint as n, sum((event_type = 'click')::int)::bigint as matches from events group by 1")
def a4_answer_distribution(spark, d):
    k = F.nullif(F.get_json_object("props", "$.k"), F.lit("5"))
    return table(spark, d, "events").groupBy(F.coalesce(k, F.lit("parse_fail")).alias("letter")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("matches"))


@query("select count(distinct l_suppkey % 4)::bigint as models, count(distinct l_orderkey)::bigint as questions from lineitem")
def a5_distinct_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct(F.col("l_suppkey") % 4).alias("models"), F.count_distinct("l_orderkey").alias("questions"))


@query("select r_name, count(n_nationkey)::bigint as n from region left join nation on r_regionkey = n_regionkey group by 1")
def a7_fixed_key_counts(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.join(n, r["r_regionkey"] == n["n_regionkey"], "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))


@query("select round(coalesce(sum(value), 0), 4) as total from events")
def a20_ledger_total(spark, d):
    return ledger.total(table(spark, d, "events"), "value")


@query("select round(coalesce(sum(value), 0), 4) as total from events where starts_with(event_type, 'p')")
def a21_filtered_sum(spark, d):
    return ledger.total(table(spark, d, "events"), "value", "event_type like 'p%'")


_USAGE = "(select event_type, event_id % 1000 as input, case when event_id % 3 = 0 then event_id % 70 end as cached, event_id % 90 as output from events)"


@query(f"select event_type, sum(coalesce(input, 0))::bigint as input, sum(coalesce(cached, 0))::bigint as cached, sum(coalesce(output, 0))::bigint as output, sum((coalesce(cached, 0) > 0)::int)::bigint as cache_hits, count(*)::bigint as requests from {_USAGE} group by 1")
def a22_usage_totals(spark, d):
    e = F.col("event_id")
    u = table(spark, d, "events").select("event_type", (e % 1000).alias("input"), F.when(e % 3 == 0, e % 70).alias("cached"), (e % 90).alias("output"))
    return ledger.usage_totals(u, ["event_type"], ["input", "cached", "output"])


@query("select o.n as outcomes, i.n as inputs, case when o.n >= i.n then 'complete' else 'partial' end as state from (select count(*)::bigint as n from labels) o, (select count(*)::bigint as n from documents) i")
def a25_reconcile(spark, d):
    return stats.reconcile(table(spark, d, "labels"), table(spark, d, "documents"))


@query("select count(*)::bigint as wanted, count(l.doc_id)::bigint as have, round(count(l.doc_id) / count(*), 9) as coverage from documents d left join labels l using (doc_id)")
def a26_coverage(spark, d):
    return stats.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("select median(l_quantity) as median_a, median(l_extendedprice) as median_b, round(median(l_quantity) / median(l_extendedprice), 9) as ratio from lineitem")
def a27_median_ratio(spark, d):
    return stats.median_ratio(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("select event_type, round(quantile_cont(value, 0.9), 6) as p90 from events group by 1")
def a28_percentile_linear(spark, d):
    return stats.percentile_linear(table(spark, d, "events"), ["event_type"], "value", 0.9).select("event_type", F.round("percentile", 6).alias("p90"))


@query("select event_type, (list_sort(list(value)))[1 + round_even(0.95 * (count(*) - 1), 0)::int] as p95 from events group by 1")
def a29_percentile_nearest(spark, d):
    return stats.percentile_nearest(table(spark, d, "events"), ["event_type"], "value", 0.95).select("event_type", F.col("percentile").alias("p95"))


@query("select lang, max(n_chars) as longest, (list_sort(list(n_chars)))[1 + least(floor(0.99 * count(*)), count(*) - 1)::int] as p99, max(n_chars) <= 100000 as fits from documents group by 1")
def a30_percentile_trunc(spark, d):
    also = [F.max("n_chars").alias("longest"), (F.max("n_chars") <= 100000).alias("fits")]
    p = stats.percentile_trunc(table(spark, d, "documents"), ["lang"], "n_chars", 0.99, also)
    return p.select("lang", "longest", F.col("percentile").alias("p99"), "fits")


@query("select lang, count(n_chars)::bigint as n, round(avg(n_chars), 6) as mean, median(n_chars) as median, quantile_cont(n_chars, 0.9) as p90 from documents group by 1")
def a31_length_summary(spark, d):
    return stats.length_summary(table(spark, d, "documents"), ["lang"], "n_chars")


@query("select lang, n, round(100 * n / sum(n) over (), 6) as percent from (select lang, count(*)::bigint as n from documents group by 1)")
def a32_source_mix(spark, d):
    return stats.source_mix(table(spark, d, "documents"), "lang")


@query("select min(m) as low, max(m) as high, round(max(m) / min(m), 9) as divergence from (select lang, median(n_chars) as m from documents group by 1)")
def a33_divergence(spark, d):
    return stats.divergence(table(spark, d, "documents"), "lang", "n_chars")


@query("select sum(regexp_matches(text, 'token|secret')::int + regexp_matches(source, 'src1')::int)::bigint as hits, count(*)::bigint as n from documents")
def a34_pattern_hits(spark, d):
    docs = table(spark, d, "documents")
    a = stats.pattern_hits(docs, ["text"], "token|secret").select(F.col("hits").alias("x"), "n")
    b = stats.pattern_hits(docs, ["source"], "src1").select(F.col("hits").alias("y"))
    return a.crossJoin(F.broadcast(b)).select((F.col("x") + F.col("y")).cast("long").alias("hits"), "n")  # one row each


@query(f"select slice, count(*)::bigint as n, sum((human <> 'TIE')::int)::bigint as decided from {TRUTH} group by 1")
def a35_progress(spark, d):
    return truth(spark, d).groupBy("slice").agg(F.count("*").alias("n"), F.count_if(F.col("human") != "TIE").alias("decided"))


@query("select event_type, count(*)::bigint as n, round(count(*) * 60 / sum(value), 4) as per_minute, round(sum(event_id % 90) / sum(value), 4) as tokens_per_second from events group by 1")
def a36_throughput(spark, d):
    return stats.throughput(table(spark, d, "events").withColumn("tokens", F.col("event_id") % 90), ["event_type"], "value", "tokens")


_CALL = "(select event_type, value as total, value / 4 as first, event_id % 13 = 0 as failed, event_id % 7 = 0 as degraded, event_id % 90 as tokens from events)"


def _rank(x, p):
    return f"(list_sort(list({x}) filter ({x} is not null)))[1 + round_even({p} * (count({x}) - 1), 0)::int]"


_F, _T = "(case when not failed and not degraded then first end)", "(case when not failed then total end)"


@query(f"""select event_type, count(*)::bigint as calls, sum(failed::int)::bigint as failures, {_rank(_F, 0.5)} as first_p50, {_rank(_F, 0.95)} as first_p95, {_rank(_T, 0.5)} as total_p50, {_rank(_T, 0.95)} as total_p95,
  round(sum(case when not failed then tokens end) / sum({_T}), 6) as tokens_per_second from {_CALL} group by 1""")
def a37_latency(spark, d):
    e = F.col("event_id")
    c = table(spark, d, "events").select("event_type", F.col("value").alias("total"), (F.col("value") / 4).alias("first"), (e % 13 == 0).alias("failed"), (e % 7 == 0).alias("degraded"), (e % 90).alias("tokens"))
    return stats.latency(c, ["event_type"], "total", "first", "failed", "degraded", "tokens")


@query("select round(sum(value) / count(*), 9) as hosted_call, 2.5 / 19197::double as self_call, round(sum(value) / count(*) / (2.5 / 19197::double), 6) as ratio from events")
def a38_cost_comparison(spark, d):
    one = table(spark, d, "events").agg(F.sum("value").alias("s"), F.count("*").alias("n")).first()  # one row
    c = stats.cost_comparison(one["s"], one["n"], 2.5, 19197.0, spark)
    return c.select(F.round("hosted_call", 9).alias("hosted_call"), "self_call", F.round("ratio", 6).alias("ratio"))


@query("select event_type, min_by(event_id, ts) as first_id from events group by 1")
def a39_first_per_class(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min_by("event_id", "ts").alias("first_id"))


@query("select source, count(distinct sha256(lang)) = 1 as agree, count(distinct sha256(lang))::bigint as renderings from documents group by 1")
def a40_renderings(spark, d):
    h = F.count_distinct(F.sha2("lang", 256))
    return table(spark, d, "documents").groupBy("source").agg((h == 1).alias("agree"), h.alias("renderings"))


@query("select count(*)::bigint as n, (sum(length(text)) // 4)::bigint as input_tokens, floor(count(*) * 1024 / 2)::bigint as output_tokens from documents")
def a42_rough_tokens(spark, d):
    t = ledger.rough_tokens(table(spark, d, "documents"), ["text"], 1024)
    return t.select("n", "input_tokens", "output_tokens")


@query("select n, round(case when n > 0 then (2000 / 1e6 * 3.0 * 1.25 + (n - 1) * (2000 / 1e6 * 0.3) + n * (700 / 1e6 * 3.0 + 300 / 1e6 * 15.0)) * 0.5 else 0 end, 9) as cost from (select event_type, count(*)::bigint as n from events group by 1)")
def a43_synth_projection(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("n", F.round(cost.synth_projection(F.col("n"), 2000, 700, 300, 3.0, 0.3, 15.0), 9).alias("cost"))


@query("select count(*)::bigint as n, round(sum(value) * 100000 / count(*), 4) as projected from events")
def a44_cost_projection(spark, d):
    return ledger.projected(table(spark, d, "events"), "value", 100000)


@query("select 'labels' as item, count(*)::bigint as n from labels union all select 'documents', count(*)::bigint from documents union all select 'events', count(*)::bigint from events")
def a45_status(spark, d):
    out = None
    for name in ("labels", "documents", "events"):
        one = table(spark, d, name).agg(F.lit(name).alias("item"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select model, {', '.join(f'sum((run = {i})::int)::bigint as run_{i}' for i in range(5))} from {SAMPLED} where verdict <> 'PARSE_FAIL' group by 1")
def a46_progress_by_pass(spark, d):
    s = sampled(spark, d).where("verdict <> 'PARSE_FAIL'")
    return s.groupBy("model").agg(*[F.count_if(F.col("run") == i).alias(f"run_{i}") for i in range(5)])


@query("select event_id, user_id, event_type, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as spent from events")
def w13_running_spend(spark, d):
    return ledger.running(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "event_type", "spent")


@query("""with l as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n, value / 100 as margin, (event_id % 100) / 100.0::double as accuracy,
    -value / 10 as chosen, -value / 9 as rejected from events),
  m as (select *, case when n // 2 >= n - 1 then greatest(n - 2, 0) else n // 2 end as mid from l),
  g as (select user_id, max(n)::bigint as n_points, max(case when i = n - 1 then margin end) - max(case when i = mid then margin end) as md, max(case when i = n - 1 then chosen end) - max(case when i = mid then chosen end) as cd,
    max(case when i = n - 1 then rejected end) - max(case when i = mid then rejected end) as rd, max(case when i = n - 1 then accuracy end) as a from m group by 1)
  select user_id, n_points, round(md, 9) as margin_delta, round(cd, 9) as chosen_delta, round(rd, 9) as rejected_delta, round(a, 9) as final_accuracy,
    case when n_points < 2 then 'INSUFFICIENT_DATA' when a < 0.5 or md <= 0.1 then 'ABORT' when cd < -3 and rd < -3 and md < 0.5 then 'ABORT' when md > 0.5 and a >= 0.55 then 'OK' else 'WARN' end as verdict from g""")
def g10_overcollapse(spark, d):
    e = table(spark, d, "events")
    log = e.select("user_id", "ts", "event_id", (F.col("value") / 100).alias("margin"), ((F.col("event_id") % 100) / 100.0).alias("accuracy"), (-F.col("value") / 10).alias("chosen"), (-F.col("value") / 9).alias("rejected"))
    log = log.withColumn("at", F.struct("ts", "event_id"))
    return gates.overcollapse(log, ["user_id"], "at")


@query("""select 'generation' as gate, case when total = 0 or parsed < 0.5 * total then 5 when matches / parsed < 0.1 then 4 else 0 end as decision,
  case when total = 0 then 'no rows' when parsed < 0.5 * total then 'parse rate too low' when matches / parsed < 0.1 then 'match rate too low' else 'pass' end as reason
  from (select count(*) as total, count(*) - sum((event_type = 'error')::int) as parsed, sum((event_type = 'click')::int) as matches from events)""")
def g1_generation_gate(spark, d):
    e = F.col("event_type")
    return gates.generation(table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(e == "error").alias("failed"), F.count_if(e == "click").alias("matches")))


@query("""select 'labeler' as gate, case when hard < 22 then 'ABORT' when overall >= 46 and hard >= 24 then 'PROCEED' else 'REVIEW' end as decision,
  'overall ' || overall || ' (need 46), hard ' || hard || ' (need 24, abort under 22)' as reason from (select sum((doc_id < 50)::int)::bigint as overall, sum((doc_id < 23)::int)::bigint as hard from documents)""")
def g2_labeler_gate(spark, d):
    return gates.labeler(table(spark, d, "documents").agg(F.count_if(F.col("doc_id") < 50).alias("overall"), F.count_if(F.col("doc_id") < 23).alias("hard")))


@query("""select 'flip_rate' as gate, case when r is null or r <= 0.1 then 'PASS' else 'FAIL' end as decision, 'rate ' || r || ', at most 0.1' as reason from (select round(avg((quality <> toxic)::int), 6) as r from labels)""")
def g5_flip_gate(spark, d):
    return gates.at_most(table(spark, d, "labels").agg(F.avg((F.col("quality") != F.col("toxic")).cast("int")).alias("rate")), "flip_rate", "rate", 0.1)


@query("""select 'coverage' as gate, case when c >= 0.95 then 'PASS' else 'FAIL' end as decision, 'coverage ' || round(c, 6) || ', at least 0.95' as reason
  from (select round(count(l.doc_id) / count(*), 9) as c from documents left join labels l using (doc_id))""")
def g8_coverage_gate(spark, d):
    return gates.at_least(stats.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id"), "coverage", "coverage", 0.95)


@query("select 'budget' as gate, case when s <= 1000 then 'PROCEED' else 'STOP' end as decision, printf('%.6f of 1000.000000', s) as reason from (select round(sum(value), 4) + 12.5 as s from events)")
def g9_budget_gate(spark, d):
    t = ledger.total(table(spark, d, "events"), "value").select(F.col("total").alias("spent"), F.lit(12.5).alias("projected"))
    return gates.budget(t, 1000.0)


_PRICES = [("click", 3.0, 0.3, 15.0), ("view", 5.0, 0.5, 20.0), ("purchase", 0.2, 0.2, 0.6)]


def _priced_sql(fresh, created):
    return f"""select event_type, round(sum(coalesce(({fresh} / 1e6 * pi + {created} + coalesce(cached, 0) / 1e6 * pc + output / 1e6 * po) * case when batch then 0.5 else 1 end, 0)), 9) as cost_usd
      from (select event_type, (event_id % 1000)::double as input, case when event_id % 3 = 0 then event_id % 70 end as cached, event_id % 11 as created, event_id % 90 as output, event_id % 2 = 0 as batch from events)
      left join (values {', '.join(str(p) for p in _PRICES)}) p(event_type, pi, pc, po) using (event_type) group by 1"""


def _priced(spark, d, convention):
    e = F.col("event_id")
    u = table(spark, d, "events").select(F.col("event_type").alias("model"), (e % 1000).alias("input"), F.when(e % 3 == 0, e % 70).alias("cached"), (e % 11).alias("created"), (e % 90).alias("output"), (e % 2 == 0).alias("batch"))
    p = spark.createDataFrame(_PRICES, "model string, price_in double, price_cached double, price_out double")
    return cost.priced(u, p, convention).groupBy(F.col("model").alias("event_type")).agg(F.round(F.sum("cost_usd"), 9).alias("cost_usd"))


@query(_priced_sql("(greatest(input - coalesce(cached, 0), 0) + created)", "0"))
def m1_token_cost(spark, d):
    return _priced(spark, d, "inclusive")


@query(_priced_sql("input", "created * 1.25 / 1e6 * pi"))
def m2_token_cost_exclusive(spark, d):
    return _priced(spark, d, "exclusive")


@query("""select event_id, round((case event_id % 3 when 0 then 1.86 when 1 then 4.4 else 0.135 end)::double / 3600 * value, 9) as usd from events""")
def m3_gpu_cost(spark, d):
    gpu = F.element_at(F.array(F.lit("A100"), F.lit("H100"), F.lit("unknown")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.round(cost.gpu_cost(gpu, F.col("value")), 9).alias("usd"))


@query("select l_linenumber, ceil(count(*) / 7)::bigint as each, round_even(count(*) / 2, 0)::bigint as half from lineitem group by 1")
def m4_ceil_and_half_even(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return g.select("l_linenumber", cost.ceil_div(F.col("n"), F.lit(7)).alias("each"), F.bround(F.col("n") / 2).cast("long").alias("half"))


@query(f"select p as pass, t as temperature, s as swapped, r as run_index from (values {', '.join(f'({chr(39)}{a}{chr(39)}, {b}::double, {str(c).lower()}, {e}::int)' for a, b, c, e in PASSES)}) v(p, t, s, r)")
def c5_pass_spec(spark, d):
    from tallyloom.operators.formatting import pass_spec

    return pass_spec(spark)


@query("select 'ratio' as gate, case when r <= 1.25 then 'PASS' else 'FAIL' end as decision, 'ratio ' || round(r, 6) || ', at most 1.25' as reason from (select round(median(l_tax) / median(l_discount), 9) as r from lineitem)")
def g6_median_ratio_gate(spark, d):
    return gates.at_most(stats.median_ratio(table(spark, d, "lineitem"), "l_tax", "l_discount"), "ratio", "ratio", 1.25)


@query("""with x as (select round(median(case when lang = 'en' then n_chars end) / median(case when lang = 'fr' then n_chars end), 6) as m, round(quantile_cont(case when lang = 'en' then n_chars end, 0.9) / quantile_cont(case when lang = 'fr' then n_chars end, 0.9), 6) as p from documents),
  g as (select round(max(m) / min(m), 6) as v from (select lang, median(n_chars) as m from documents group by 1))
  select 'median_ratio' as gate, case when m <= 1.15 then 'PASS' else 'BLOCK' end as decision from x union all select 'p90_ratio', case when p <= 1.2 then 'PASS' else 'WARN' end from x union all select 'divergence', case when v <= 1.25 then 'PASS' else 'WARN' end from g""")
def g7_length_gates(spark, d):
    of = lambda lang: F.when(F.col("lang") == lang, F.col("n_chars")).alias(lang)
    docs = table(spark, d, "documents").select("lang", "n_chars", of("en"), of("fr"))
    both = stats.length_ratios(docs, "en", "fr").crossJoin(F.broadcast(stats.divergence(docs, "lang", "n_chars").select("divergence")))  # one row each
    return gates.length_gates(both).select("gate", "decision")


@query("select 'phase' as gate, case when s <> 'complete' then 'STOP' when h <> 'a' then 'STOP' else 'PROCEED' end as decision, case when s <> 'complete' then 'prior phase incomplete' when h <> 'a' then 'prompt changed' else 'ready' end as reason from (values ('complete', 'a'), ('running', 'a'), ('complete', 'b')) t(s, h)")
def g11_phase_gate(spark, d):
    return gates.phase(spark.createDataFrame([("complete", "a", "a"), ("running", "a", "a"), ("complete", "b", "a")], "prior_status string, prompt_hash string, expected_hash string"))


@query("select 'ceiling' as gate, case when n <= 3040 then 'PASS' else 'FAIL' end as decision, 'tokens ' || n::double || ', at most 3040' as reason from (select max(length(text)) as n from conversations)")
def g13_ceiling_gate(spark, d):
    return gates.at_most(table(spark, d, "conversations").agg(F.max(F.length("text")).alias("tokens")), "ceiling", "tokens", 3040)


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def w10_last_write(spark, d):
    from tallyloom.operators.merge import last_write

    return last_write(table(spark, d, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("""with l as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events)
  select user_id, round(max(case when i = n - 1 then value end) - max(case when i = case when n // 2 >= n - 1 then greatest(n - 2, 0) else n // 2 end then value end), 9) as delta from l group by 1""")
def w12_back_half_delta(spark, d):
    e = table(spark, d, "events")
    z = F.lit(0.0)
    log = e.select("user_id", F.struct("ts", "event_id").alias("at"), F.col("value").alias("margin"), z.alias("accuracy"), z.alias("chosen"), z.alias("rejected"))
    return gates.overcollapse(log, ["user_id"], "at").select("user_id", F.col("margin_delta").alias("delta"))


@query("select l_orderkey, round_even(sum(l_quantity) / 2, 0)::bigint as half, round(sum(l_extendedprice * l_tax), 4) as tax, round(sum(l_tax) / nullif(sum(l_discount), 0), 9) as ratio, coalesce(round(sum(l_tax) / nullif(sum(l_discount), 0), 9), 0) as ratio0 from lineitem group by 1")
def m5_rounding_and_ratios(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("t"), F.sum("l_tax").alias("x"), F.sum("l_discount").alias("y"))
    r = cost.ratio(F.col("x"), F.col("y"))
    return g.select("l_orderkey", F.bround(F.col("q") / 2).cast("long").alias("half"), F.round("t", 4).alias("tax"), F.round(r, 9).alias("ratio"), F.round(cost.ratio(F.col("x"), F.col("y"), 0.0), 9).alias("ratio0"))


@query("select event_id, round(2.5 / 3600 * (event_id % 7200), 9) as worst from events")
def m8_worst_case(spark, d):
    return table(spark, d, "events").select("event_id", F.round(cost.gpu_cost(F.lit("A100-80GB"), F.col("event_id") % 7200), 9).alias("worst"))
