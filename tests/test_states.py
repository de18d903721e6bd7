"""Streams with keyed state: any cutting of the log and a restart half-way give the same states as one pass in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import states

SCHEMA = "k string, ts timestamp, n long, status string, failed boolean, cost long"
HOUR = 3_600_000_000
STATUS = ["submitted", "running", "ended", "failed", "fetched"]


def made(seed, n=240):
    rnd = random.Random(seed)
    t, rows = 1_700_000_000_000_000, []
    for i in range(n):
        t += rnd.choice([0, 0, 1_000_000, HOUR // 4, HOUR, 3 * HOUR])
        rows.append((rnd.choice(["a", "b", "c", "d", None]), t, i, rnd.choice(STATUS), rnd.random() < 0.5, rnd.randrange(50)))
    return rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if r[0] is not None:
            out.setdefault(r[0], []).append(r)
    return out


def phases(rows, patience, end):
    return {k: (("expired" if rs[-1][3] not in states.DONE and (rs[-1][1] + patience) // 1000 <= end else rs[-1][3]), len(rs)) for k, rs in by_key(rows).items()}


def cache(rows, ttl, end):
    out = {}
    for k, rs in by_key(rows).items():
        gaps = [b[1] - a[1] for a, b in zip(rs, rs[1:])]
        stale = sum(g > ttl for g in gaps)
        out[k] = (sum(g <= ttl for g in gaps), 1 + stale, stale + ((rs[-1][1] + ttl) // 1000 <= end))
    return out


def dead(rows, attempts):
    out = {}
    for k, rs in by_key(rows).items():
        run_, most = 0, 0
        for r in rs:
            run_ = run_ + 1 if r[4] else 0
            most = max(most, run_)
        out[k] = (run_, sum(r[4] for r in rs), most >= attempts)
    return out


def spend(rows, cap):
    out = {}
    for k, rs in by_key(rows).items():
        total, taken = 0, 0
        for r in rs:
            if total + r[5] > cap:
                break
            total, taken = total + r[5], taken + 1
        out[k] = (total, taken, len(rs) - taken)
    return out


def feed(spark, folder, rows, nth):
    """One file, later than those before it."""
    at = F.timestamp_micros("ts")
    spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", at).coalesce(1).write.parquet(f"{folder}/n={nth:03d}")


@pytest.mark.parametrize("cuts", [[240], [1, 7, 80, 81, 200, 240]])
def test_states_in_any_cutting(spark, tmp_path, cuts):
    rows = made(len(cuts))
    late, patience, ttl = HOUR, 2 * HOUR, HOUR // 2
    end = (max(r[1] for r in rows if r[0]) - late) // 1000
    kinds = {
        "phase": (states.Phases(patience), lambda s: (s["status"], s["reports"]), phases(rows, patience, end)),
        "entry": (states.Cache(ttl), lambda s: (s["hits"], s["misses"], s["evictions"]), cache(rows, ttl, end)),
        "tries": (states.DeadLetters(3), lambda s: (s["row"], s["failures"], s["dead"]), dead(rows, 3)),
        "spend": (states.Spend(400), lambda s: (s["spent"], s["admitted"], s["refused"]), spend(rows, 400)),
    }
    log = tmp_path / "log"
    begin = 0
    for nth, cut in enumerate(cuts):
        feed(spark, log, rows[begin:cut], nth)
        begin = cut
        if nth not in (len(cuts) // 2, len(cuts) - 1):
            continue  # the streams run, stop, and go on from their checkpoints
        for name, (processor, _, _) in kinds.items():
            stream = spark.readStream.schema(SCHEMA + ", n2 int").option("maxFilesPerTrigger", 1).parquet(f"{log}/*")
            c = F.col
            read = states.log_rows(stream, c("k"), c("ts"), c("n"), "1 hour", status=c("status"), failed=c("failed"), cost=c("cost"))
            states.run(read, processor, type(processor).out, str(tmp_path / name), str(tmp_path / f"{name}-rows"))
    for name, (processor, show, want) in kinds.items():
        got = {r["key"]: show(r) for r in states.states(spark, str(tmp_path / name), name).collect()}
        assert got == want, name
    letters = [r["key"] for r in spark.read.parquet(str(tmp_path / "tries-rows")).collect()]
    assert sorted(letters) == sorted(k for k, v in kinds["tries"][2].items() if v[2])  # each once
