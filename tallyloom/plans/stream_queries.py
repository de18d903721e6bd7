"""Bounded streams over events: each runs to the end of the log and returns the states it leaves (§2.11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.operators import sampling
from tallyloom.plans.analogues import table
from tallyloom.plans.registry import query
from tallyloom.sources import jsonl, versions
from tallyloom.sources.logsource import AppendLog
from tallyloom.sources.scratch import run_folder
from tallyloom.streaming import incremental, states

HOUR = 3_600_000_000
STATUS = {"signup": "submitted", "view": "running", "click": "running", "purchase": "ended", "error": "failed"}
PATIENCE, TTL, LATE, ATTEMPTS, CAP = 6 * HOUR, 12 * HOUR, HOUR, 2, 30_000


def _log(spark, d):
    return incremental.table_stream(spark, f"{d}/events.parquet")


def _left(spark, d, processor, **fields):
    """The final states of a processor over all events, keyed by user."""
    at = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = states.log_rows(_log(spark, d), F.col("user_id"), F.col("ts"), F.col("event_id"), "1 hour", **fields)
    states.run(rows, processor, type(processor).out, f"{at}/checkpoint", f"{at}/rows")
    return states.states(spark, f"{at}/checkpoint", processor.name)


_US = "epoch_us(ts)"
_END = f"(select (max({_US}) - {LATE}) // 1000 from events where user_id is not null)"
_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATUS.items()) + " end"


@query(f"""with last as (select user_id, arg_max({_CASE}, (ts, event_id)) as s, max({_US}) as t, count(*)::bigint as reports from events where user_id is not null and ts is not null group by 1),
  x as (select *, case when s not in ('ended', 'failed') and (t + {PATIENCE}) // 1000 <= {_END} then 'expired' else s end as status from last)
  select user_id::varchar as key, status, reports, case when status = 'ended' then 'fetch' when status in ('failed', 'expired') then 'submit' else 'poll' end as action from x""")
def stream_phases(spark, d):
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    left = _left(spark, d, states.Phases(PATIENCE), status=status)
    action = F.when(F.col("status") == "ended", "fetch").when(F.col("status").isin("failed", "expired"), "submit").otherwise("poll")
    return left.select("key", "status", "reports", action.alias("action"))


@query(f"""with g as (select user_id, {_US} as t, {_US} - lag({_US}) over (partition by user_id order by ts, event_id) as gap from events where user_id is not null and ts is not null)
  select user_id::varchar as key, count(*) filter (gap <= {TTL})::bigint as hits, count(*) filter (gap is null or gap > {TTL})::bigint as misses,
  (count(*) filter (gap > {TTL}) + ((max(t) + {TTL}) // 1000 <= {_END})::int)::bigint as evictions from g group by 1""")
def stream_cache(spark, d):
    return _left(spark, d, states.Cache(TTL)).select("key", "hits", "misses", "evictions")


@query(f"""with f as (select user_id, event_type = 'error' as failed, lag(event_type = 'error') over (partition by user_id order by ts, event_id) as before from events where user_id is not null)
  select user_id::varchar as key, count(*) filter (failed)::bigint as failures, coalesce(bool_or(failed and before), false) as dead from f group by 1""")
def stream_dead_letters(spark, d):
    return _left(spark, d, states.DeadLetters(ATTEMPTS), failed=F.col("event_type") == "error").select("key", "failures", "dead")


@query(f"""with s as (select user_id, round(value * 100)::bigint as cost, sum(round(value * 100)::bigint) over (partition by user_id order by ts, event_id) as upto from events where user_id is not null)
  select user_id::varchar as key, coalesce(sum(cost) filter (upto <= {CAP}), 0)::bigint as spent, count(*) filter (upto <= {CAP})::bigint as admitted, count(*) filter (upto > {CAP})::bigint as refused from s group by 1""")
def stream_spend_cap(spark, d):
    return _left(spark, d, states.Spend(CAP), cost=F.round(F.col("value") * 100).cast("long")).select("key", "spent", "admitted", "refused")


@query("select distinct user_id, event_type from events")
def stream_skip_set(spark, d):
    at = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    work = _log(spark, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", "user_id", "event_type").alias("key"))
    once = incremental.pending_stream(work, "key", "ts", "60 days").select("user_id", "event_type")
    once.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{at}/rows")


@query("""select c_custkey, c_name, coalesce(v, c_acctbal) as c_acctbal from customer left join (select user_id, arg_max(value, (ts, event_id)) as v from events where user_id is not null group by 1) on user_id = c_custkey""")
def j9_merge_commits(spark, d):
    """The last event of a user overwrites the customer's balance: streamed into a bucketed table, a commit a micro-batch."""
    at = f"{run_folder(spark)}/merge-{uuid.uuid4().hex}"
    versions.publish(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), f"{at}/table", "c_custkey", 32)
    patches = _log(spark, d).select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), "ts", "event_id").where("c_custkey is not null")
    versions.merge_stream(patches, f"{at}/table", ["ts", "event_id"], f"{at}/checkpoint").awaitTermination()
    return versions.read(spark, f"{at}/table")


@query("""select 'last' as version, o_orderstatus, count(*)::bigint as n from orders group by 2 union all
  select 'first', o_orderstatus, count(*)::bigint from orders where o_orderstatus = 'F' group by 2""")
def k2_versions(spark, d):
    path, o = f"{run_folder(spark)}/versions-{uuid.uuid4().hex}", table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    versions.publish(o.where("o_orderstatus = 'F'"), path)
    versions.publish(o, path)
    count = lambda n, name: versions.read(spark, path, n).groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit(name).alias("version"), "o_orderstatus", "n")
    return count(2, "last").unionAll(count(1, "first"))


@query("select event_id, event_type, (row_number() over (order by event_id))::bigint as nth from events where event_type <> 'view'")
def stream_log_lines(spark, d):
    """A log of all events in parts, read as a stream of its byte ranges; a line's place orders it."""
    at = f"{run_folder(spark)}/log-{uuid.uuid4().hex}"
    jsonl.write_log(table(spark, d, "events"), f"{at}/text", F.col("event_id").asc_nulls_last(), F.to_json(F.struct("event_id", "event_type")))
    spark.dataSource.register(AppendLog)
    lines = spark.readStream.format("append_log").option("path", f"{at}/text").option("parts", "true").option("split", 256 << 10).load()
    q = lines.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").start()
    q.processAllAvailable()
    q.stop()
    read = spark.read.schema("line string, at long").parquet(f"{at}/rows").select("at", F.from_json("line", "event_id long, event_type string").alias("r"))
    kept = read.select("at", "r.*").where("event_type <> 'view'")
    return sampling.chunks(kept, "at", 1).select("event_id", "event_type", (F.col("chunk") + 1).alias("nth"))
