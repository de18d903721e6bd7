"""Keyed state with timers: phases, a cache with a time to live, dead letters, spend under a cap (``transformWithState``).

The state lives in RocksDB beside the executors and is checkpointed with the offsets, so a stream that is stopped anywhere goes on
where it was. Times are event times in microseconds; timers follow the watermark, never the clock. Rows of a key are put in order of
(at, tie) within a micro-batch, and an append-only log brings them in order from batch to batch; so where a log is cut
into micro-batches makes no difference to the states.

Rows without a key or a time are left out. A key is a string. What a key's task holds is its rows of one micro-batch, which
``maxFilesPerTrigger`` bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("ended", "failed", "fetched")


def log_rows(log: DataFrame, key: Column, ts: Column, tie: Column, late: str, **fields: Column) -> DataFrame:
    """What the processors read: key, at, tie and their own fields, with a watermark."""
    rows = log.select(key.cast("string").alias("key"), ts.cast("timestamp").alias("_ts"), tie.cast("long").alias("tie"), *[c.alias(k) for k, c in fields.items()])
    rows = rows.where("key is not null and _ts is not null").withWatermark("_ts", late)
    return rows.withColumn("at", F.unix_micros("_ts"))


def run(rows: DataFrame, processor: StatefulProcessor, schema: str, checkpoint: str, sink: str) -> None:
    """All that the log has now goes through ``processor``; its rows are appended to ``sink`` (Parquet), its state to the checkpoint.

    A batch that is repeated after an interruption writes its own folder anew, so no row is there twice.
    """
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    out = rows.groupBy("key").transformWithStateInPandas(processor, schema, "Update", "EventTime")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    q = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def states(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """(key, the fields of the state ``name``) as the last batch left them, read by the state data source."""
    s = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return s.select(F.col("key.key").alias("key"), "value.*")


def _in_order(batches: Iterator[pd.DataFrame]):
    parts = list(batches)
    return pd.concat(parts).sort_values(["at", "tie"], kind="stable").itertuples() if parts else ()


class _Keyed(StatefulProcessor):
    """One value state ``name`` a key, and a timer at most."""

    name, schema = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(self.name, self.schema)

    def known(self, otherwise: tuple) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else otherwise

    def wake(self, micros: int | None) -> None:
        """The one timer that is set from now on; timers count in milliseconds and fire after the watermark has passed them."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if micros is not None:
            self.handle.registerTimer(micros // 1000)


class Phases(_Keyed):
    """§2.11 state machine: the last status of each phase, its reports, and what is to be done next.

    ``status``: submitted, running, ended, failed or fetched. A phase in flight that is silent for ``patience`` microseconds
    expires; a later report takes it up again.
    """

    name, schema = "phase", "status string, at long, tie long, reports long"
    out = "key string, status string, reports long, action string"

    def __init__(self, patience: int):
        self.patience = patience

    @staticmethod
    def row(key, status: str, reports: int) -> pd.DataFrame:
        action = "fetch" if status == "ended" else "submit" if status in ("failed", "expired") else "none" if status == "fetched" else "poll"
        return pd.DataFrame({"key": [key[0]], "status": [status], "reports": [reports], "action": [action]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, at, tie, reports = self.known(("", -1, -1, 0))
        for r in _in_order(rows):
            reports += 1
            if (r.at, r.tie) >= (at, tie):
                status, at, tie = r.status, int(r.at), int(r.tie)
        self.state.update((status, at, tie, reports))
        self.wake(None if status in DONE else at + self.patience)
        yield self.row(key, status, reports)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at, tie, reports = self.known(("", -1, -1, 0))
        self.state.update(("expired", at, tie, reports))
        yield self.row(key, "expired", reports)


class Cache(_Keyed):
    """§2.11 prediction cache: an answer is kept for ``ttl`` microseconds from its last use; hits, misses and evictions a key."""

    name, schema = "entry", "used long, live boolean, hits long, misses long, evictions long"
    out = "key string, hits long, misses long, evictions long"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        used, live, hits, misses, gone = self.known((-1, False, 0, 0, 0))
        for r in _in_order(rows):
            if live and r.at - used > self.ttl:
                live, gone = False, gone + 1
            hits, misses = hits + live, misses + (not live)
            used, live = int(r.at), True
        self.state.update((used, live, int(hits), int(misses), int(gone)))
        self.wake(used + self.ttl)
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "misses": [misses], "evictions": [gone]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        used, _, hits, misses, gone = self.known((-1, False, 0, 0, 0))
        self.state.update((used, False, hits, misses, gone + 1))
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "misses": [misses], "evictions": [gone + 1]})


class DeadLetters(_Keyed):
    """§2.11 retry, then dead letter: ``attempts`` failures in a row; a success before that starts the count again. Dead keys stay dead."""

    name, schema = "tries", "row long, failures long, dead boolean"
    out = "key string, failures long, dead boolean"

    def __init__(self, attempts: int):
        self.attempts = attempts

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        row, failures, dead = self.known((0, 0, False))
        was = dead
        for r in _in_order(rows):
            row = row + 1 if r.failed else 0
            failures += bool(r.failed)
            dead = dead or row >= self.attempts
        self.state.update((int(row), int(failures), bool(dead)))
        if dead and not was:
            yield pd.DataFrame({"key": [key[0]], "failures": [failures], "dead": [True]})


class Spend(_Keyed):
    """§2.11 ledger with a cap: costs (integers) are admitted in order until one doesn't fit; from then on the key is stopped."""

    name, schema = "spend", "spent long, admitted long, refused long"
    out = "key string, spent long, admitted long, refused long"

    def __init__(self, cap: int):
        self.cap = cap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spent, admitted, refused = self.known((0, 0, 0))
        for r in _in_order(rows):
            if not refused and spent + r.cost <= self.cap:
                spent, admitted = spent + int(r.cost), admitted + 1
            else:
                refused += 1
        self.state.update((spent, admitted, refused))
        yield pd.DataFrame({"key": [key[0]], "spent": [spent], "admitted": [admitted], "refused": [refused]})
