"""Sampling, allocation, pair construction and holdouts (W, J3-J8, A6-A9, G3, G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import gates, pairs, sampling
from tallyloom.plans.analogues import CAND, PAIRS, candidates, table
from tallyloom.plans.registry import query

STRATA = ["o_orderpriority", "o_orderstatus"]


def _h(seed, *cols):
    return f"sha1(concat_ws('|', '{seed}', {', '.join(cols)}))"


@query(f"""select o_orderpriority, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderpriority, o_orderstatus
  order by {_h(42, 'o_orderpriority', 'o_orderstatus', 'o_orderkey')}, o_orderkey) as n from orders) where n <= 40""")
def w1_stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "orders"), STRATA, "o_orderkey", 42, 40).select(*STRATA, "o_orderkey")


@query(f"""select o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by {_h(7, 'o_orderpriority', 'o_orderkey')}, o_orderkey) as n
  from orders) join (values ('1-URGENT', 30), ('2-HIGH', 20), ('5-LOW', 10)) as t(p, target) on o_orderpriority = p where n <= target""")
def w2_bucket_sample(spark, d):
    spec = spark.createDataFrame([("1-URGENT", 30), ("2-HIGH", 20), ("5-LOW", 10)], "o_orderpriority string, target long")
    return sampling.stratified(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 7, spec).select("o_orderpriority", "o_orderkey")


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_HELD = f"""(select c_custkey from (select *, row_number() over (partition by c_mktsegment order by {_h(11, 'c_mktsegment', 'c_custkey')}, c_custkey) as n
  from customer where c_acctbal > 0) where n <= 12)"""


def _holdout(spark, d):
    return sampling.holdout(table(spark, d, "customer"), F.col("c_acctbal") > 0, {s: 12 for s in _SEG}, "c_mktsegment", "c_custkey", 11)


@query(f"select c_custkey, c_mktsegment from customer where c_custkey in {_HELD}")
def w3_holdout(spark, d):
    return _holdout(spark, d)[0].select("c_custkey", "c_mktsegment")


@query(f"select c_mktsegment, count(*)::bigint as n from customer where c_custkey not in {_HELD} group by 1")
def j20_rest_after_holdout(spark, d):
    return _holdout(spark, d)[1].groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"""select question, key from (select *, row_number() over (partition by question order by {_h(3, 'key')}, key) as n from {CAND}) where n <= 2""")
def w4_cap_per_group(spark, d):
    return sampling.cap_per_group(candidates(spark, d), "question", "key", 2, 3).select("question", "key")


TARGETS = {"clear": 120, "subtle": 80, "tracked": 60, "tie": 60, "confidence": 30, "length": 40}


def _w5_sql():
    base = f"""base as materialized (select *, substr(sha1(case when concat_ws('::', question, a_model) <= concat_ws('::', question, b_model)
      then concat_ws('::', question, a_model) || '|' || concat_ws('::', question, b_model) else concat_ws('::', question, b_model) || '|' || concat_ws('::', question, a_model) end), 1, 16) as pair_id,
      {_h(42, 'question')} as q, {_h(42, 'question', 'a_key', 'b_key')} as p from {PAIRS})"""
    steps, names = [base], []
    for name, n in TARGETS.items():
        gone = " and ".join(f"pair_id not in (select pair_id from p_{x})" for x in names) or "true"
        steps.append(f"""p_{name} as materialized (select * from (select *, row_number() over (partition by question order by q, p) as n2 from (select *, row_number() over (partition by pair_id order by q, p) as n1
          from base where in_{name} and {gone}) where n1 = 1) where n2 <= 1 order by q, p limit {n})""")
        names.append(name)
    flip = "('0x' || substr(sha1('42|' || pair_id), 1, 8))::bigint % 2 = 1"
    sel = " union all ".join(
        f"""select '{x}' as bucket, question, pair_id, case when {flip} then b_key else a_key end as a_key, case when {flip} then a_key else b_key end as b_key,
        case when {flip} then b_model else a_model end as a_model, case when {flip} then a_model else b_model end as b_model from p_{x}"""
        for x in names
    )
    return f"with {', '.join(steps)} {sel}"


def _picked(spark, d):
    return pairs.sample_pairs(pairs.candidate_pairs(candidates(spark, d)), TARGETS, 42, 1)


@query(_w5_sql())
def w5_first_wins_pairs(spark, d):
    return _picked(spark, d)


@query(f"""with x as ({_w5_sql()}), t(bucket, target) as (values {', '.join(f"('{k}', {v}::bigint)" for k, v in TARGETS.items())})
  select t.bucket, any_value(target) as target, count(pair_id)::bigint as achieved, coalesce(sum((a_model <> b_model)::int), 0)::bigint as "cross",
  coalesce(sum((a_model = b_model)::int), 0)::bigint as same from t left join x using (bucket) group by 1""")
def a9_sampling_diagnostics(spark, d):
    return pairs.diagnostics(_picked(spark, d), TARGETS)


@query("""with w as (select c_mktsegment, count(*)::bigint as n from customer group by 1), s as (select *, sum(n) over () as total from w),
  b as (select *, (n * 60) // total as base, (n * 60) % total as rest from s), r as (select *, row_number() over (order by rest desc, n desc, c_mktsegment) as k, 60 - sum(base) over () as left_ from b)
  select c_mktsegment, n, (base + (k <= left_)::int)::bigint as target from r""")
def w6_largest_remainder(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return sampling.largest_remainder(g, "c_mktsegment", "n", 60)


@query(f"""with c as (select count(*) as cells from (select distinct o_orderpriority, o_orderstatus from orders)),
  s as (select *, row_number() over (partition by o_orderpriority, o_orderstatus order by {_h(5, 'o_orderpriority', 'o_orderstatus', 'o_orderkey')}, o_orderkey) as n from orders, c)
  select o_orderkey, o_orderpriority from (select * from s where n <= ceil(100 / cells)) order by {_h(5, 'o_orderkey')}, o_orderkey limit 100""")
def w7_ceil_quota_trim(spark, d):
    return sampling.ceil_quota_then_trim(table(spark, d, "orders"), STRATA, "o_orderkey", 100, 5).select("o_orderkey", "o_orderpriority")


@query("""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by sha1(doc_id::varchar), doc_id) as n from documents) where n <= 25""")
def w8_hash_top_n(spark, d):
    return sampling.top_by_hash(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25, ["lang"])


@query("select user_id, max(ts) as ts, arg_max(event_id, ts) as event_id from events group by 1")
def w9_latest_by_key(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", "ts").alias("event_id"))


@query("""select doc_id, ('0x' || substr(sha1(doc_id::varchar), 1, 8))::bigint % 10 % 4 as mode from documents""")
def w11_round_robin(spark, d):
    from tallyloom.functions.hashing import split_index

    return table(spark, d, "documents").select("doc_id", (split_index(F.col("doc_id").cast("string")) % 4).alias("mode"))


@query("""select o_orderkey, ('0x' || substr(sha1('9|' || o_orderkey), 1, 8))::bigint % 2 = 1 as heads from orders""")
def w17_coin(spark, d):
    from tallyloom.functions.hashing import coin

    return table(spark, d, "orders").select("o_orderkey", coin(9, F.col("o_orderkey")).alias("heads"))


@query("select length(text)::int as n, doc_id from documents order by length(text) desc, doc_id limit 20")
def w15_longest(spark, d):
    return table(spark, d, "documents").select(F.length("text").alias("n"), "doc_id").orderBy(F.desc("n"), "doc_id").limit(20)


@query("select event_id, event_type, value from events order by ts desc, event_id desc limit 10")
def w14_last_rows(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type", "value")


@query(f"""select o_orderkey, {_h(13, 'o_orderkey')} as place from orders where o_orderstatus <> 'F'""")
def w16_visit_order(spark, d):
    return sampling.visit_order(table(spark, d, "orders"), "o_orderkey", 13, F.col("o_orderstatus") != "F").select("o_orderkey", "place")


@query("select chunk, count(*)::bigint as n, min(o_orderkey) as low, max(o_orderkey) as high from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 250 as chunk from orders) group by 1")
def w19_chunks(spark, d):
    c = sampling.chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 250)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("""with n as (select distinct c_mktsegment from customer), r as (select *, count(*) over () as k, row_number() over (order by c_mktsegment) as i from n)
  select c_mktsegment, (case when i = k then 137 - (137 // k) * (k - 1) else 137 // k end)::bigint as quota from r""")
def w20_equal_quota(spark, d):
    return sampling.equal_quota(table(spark, d, "customer"), "c_mktsegment", 137)


@query(f"select o_orderkey from orders order by {_h(21, 'o_orderkey')}, o_orderkey limit 30")
def w21_qc_sample(spark, d):
    from tallyloom.functions.hashing import hash_order

    return table(spark, d, "orders").orderBy(hash_order(21, F.col("o_orderkey")), "o_orderkey").limit(30).select("o_orderkey")


def _pool(name):
    sql = f"select question, a_key, b_key, a_model, b_model from {PAIRS} where in_{name}"

    def run(spark, d):
        return pairs.pool_pairs(candidates(spark, d), name)

    run.__name__ = {"clear": "j3", "subtle": "j4", "tracked": "j5", "tie": "j6", "length": "j7", "confidence": "j8"}[name] + f"_pairs_{name}"
    query(sql)(run)


for _name in ("clear", "subtle", "tracked", "tie", "length", "confidence"):
    _pool(_name)


@query(f"select {', '.join(f'coalesce(sum(in_{p}::int), 0)::bigint as {p}' for p in TARGETS)} from {PAIRS}")
def a8_pool_sizes(spark, d):
    return pairs.pool_sizes(candidates(spark, d)).select(*TARGETS)


@query("select o_orderpriority, o_orderstatus, count(*)::bigint as n from orders group by 1, 2")
def a6_stratum_counts(spark, d):
    return table(spark, d, "orders").groupBy(*STRATA).agg(F.count("*").alias("n"))


@query("select o_orderpriority, o_orderstatus, n, 1000 - n as missing from (select o_orderpriority, o_orderstatus, count(*)::bigint as n from orders group by 1, 2) where n < 1000")
def w2_shortfall_guard(spark, d):
    return sampling.shortfall(table(spark, d, "orders"), STRATA, 1000)


@query("""select bucket, target, achieved, round(1 - achieved::double / target, 9) as shortfall from (select o_orderpriority as bucket, 3050::bigint as target, count(*)::bigint as achieved from orders group by 1)
  where 1 - achieved::double / target > 0.01""")
def g3_shortfall_gate(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("achieved")).withColumn("target", F.lit(3050).cast("long"))
    return gates.shortfalls(g, 0.01)


@query(f"""with p as (select sum(in_subtle::int) as subtle, sum(in_length::int) as length, sum(in_confidence::int) as confidence from {PAIRS}),
  c as (select least(3000, round_even(0.02 * subtle, 0))::bigint as subtle, least(400, round_even(0.02 * length, 0))::bigint as length, least(125, round_even(0.02 * confidence, 0))::bigint as confidence from p)
  select subtle, length, confidence, least(525, length + confidence)::bigint as adversarial from c""")
def g4_dynamic_caps(spark, d):
    sizes = pairs.pool_sizes(candidates(spark, d)).first().asDict()  # six counts
    targets, split = pairs.dynamic_caps({"subtle": 3000, "adversarial": 525}, {"length": 400, "confidence": 125}, sizes, 0.02)
    return spark.createDataFrame([(targets["subtle"], split["length"], split["confidence"], targets["adversarial"])], "subtle long, length long, confidence long, adversarial long")
