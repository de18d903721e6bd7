"""Model calls and batch jobs behind table contracts: every outcome is a row, nothing raises for a single request."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.functions import udtf

from tallyloom.functions import rules
from tallyloom.sources.sinks import upsert_json

STATE = "phase string, batch_id string, model string, provider string, n_requests long, submitted_at timestamp, status string"


class Permanent(Exception):
    """An error that a retry can't mend (a 4xx status, an answer of the wrong shape)."""


def with_retries(call: Callable[[], object], attempts: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """Waits base ** n between attempts; Permanent errors are not tried again."""
    for n in range(attempts):
        try:
            return call()
        except Permanent:
            raise
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(base**n)
    raise ValueError("attempts must be positive")


def poll(status: Callable[[], str], done: frozenset[str] = frozenset({"ended", "completed", "failed", "expired", "cancelled"}), errors: int = 5, wait: float = 30.0, once: bool = False, sleep: Callable[[float], None] = time.sleep) -> str:
    """Asks until a terminal status; ``errors`` failures in a row give up; ``once`` asks a single time."""
    failed = 0
    while True:
        try:
            s = status()
            failed = 0
            if once or s in done:
                return s
        except Exception:
            failed += 1
            if failed >= errors or once:
                raise
        sleep(wait)


def submit(spark: SparkSession, state_path: str, phase: str, model: str, provider: str, n: int, send: Callable[[], str], now: str, **retry) -> str:
    """Submits unless the phase's state has a batch already, and records it."""
    from tallyloom.sources.jsonl import read_sidecar

    known = read_sidecar(spark, state_path).get(phase, {})
    if known.get("batch_id"):
        return known["batch_id"]
    batch = str(with_retries(send, **retry))
    upsert_json(spark, state_path, phase, {"batch_id": batch, "model": model, "provider": provider, "n_requests": n, "submitted_at": now, "status": "submitted"})
    return batch


def call_rows(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], key: str, prompt: str, attempts: int = 3, base: float = 2.0) -> DataFrame:
    """(key, text, error, status, seconds) of each request. ``make_client`` builds a client once a task.

    Concurrency is the number of running tasks; a rate limit is a number of partitions.
    """
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf[prompt]):
                start, text, error, status = time.time(), None, None, None
                try:
                    text = with_retries(lambda p=p: client(p), attempts, base)
                except Exception as e:
                    error, status = type(e).__name__, getattr(e, "status", None)
                out.append((k, text, error, status, time.time() - start))
            yield pd.DataFrame(out, columns=[key, "text", "error", "status", "seconds"]).astype({"status": "Int32"})

    return requests.select(key, prompt).mapInPandas(run, f"{key} {kind}, text string, error string, status int, seconds double")


def call_partitions(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], key: str, prompt: str, by: str, attempts: int = 3, base: float = 2.0) -> DataFrame:
    """§2.12: a model call as a table function over a table that is partitioned by ``by`` (a model, a provider, a tenant).

    (key, text, error, status, client, nth): ``make_client`` builds a client once a partition, so that limits and sessions belong to
    it; ``client`` names the partition's value and ``nth`` is the call's number there. Errors are rows. Rows of one partition are
    called one after another, as a session asks for; without such a need ``call_rows`` spreads them over tasks.
    """
    spark = requests.sparkSession
    columns = {"key": requests.schema[key].dataType, "text": T.StringType(), "error": T.StringType(), "status": T.IntegerType(), "client": T.StringType(), "nth": T.LongType()}
    shape = T.StructType([T.StructField(k, v) for k, v in columns.items()])

    class Calls:
        def __init__(self):
            self.client, self.nth = make_client(), 0

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or {f.name for f in rows.dataType} != {"key", "prompt", "part"}:
                raise ValueError("calls() takes a table of key, prompt and part")
            return AnalyzeResult(schema=shape, partitionBy=[PartitioningColumn("part")], orderBy=[OrderingColumn("key")])

        def eval(self, row: Row):
            text, error, status = None, None, None
            self.nth += 1
            try:
                text = with_retries(lambda: self.client(row["prompt"]), attempts, base)
            except Exception as e:
                error, status = type(e).__name__, getattr(e, "status", None)
            yield row["key"], text, error, status, row["part"], self.nth

    name = f"calls_{uuid.uuid4().hex}"
    rows = requests.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.col(by).cast("string").alias("part"))
    rows.createOrReplaceTempView(f"{name}_rows")
    spark.udtf.register(name, udtf(Calls))
    return spark.sql(f"select * from {name}(table({name}_rows))").withColumnRenamed("key", key)


def cached_calls(requests: DataFrame, cache: DataFrame, make_client, key: str, prompt: str) -> DataFrame:
    """Only what the cache lacks is called; the result has old and new rows."""
    todo = requests.join(cache.select(key), key, "left_anti")
    return cache.select(key, "text").unionByName(call_rows(todo, make_client, key, prompt).where("error is null").select(key, "text"))


def classified(results: DataFrame) -> DataFrame:
    """Failed calls with the class of their error."""
    return results.where("error is not null").withColumn("class", rules.error_class(F.col("error"), F.col("status")))


def preflight(spark: SparkSession, models: list[str], probe: Callable[[str], None]) -> DataFrame:
    """(model, state): models that aren't found are dropped, auth and rate limits stop the run, other failures keep the model."""
    out = []
    for m in models:
        try:
            probe(m)
            out.append((m, "ok"))
        except Exception as e:
            status = getattr(e, "status", None)
            if status in (401, 403, 429):
                raise
            out.append((m, "not_found" if status == 404 else "transient"))
    if not any(state != "not_found" for _, state in out):
        raise RuntimeError("no model survived the preflight")
    return spark.createDataFrame(out, "model string, state string")


def timed_calls(requests: DataFrame, make_client: Callable[[], Callable[[str], Iterator[str]]], key: str, prompt: str, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(key, text, pieces, ttft_s, total_s, degraded, error) of streamed answers; ``make_client`` builds a client once a task.

    A call that ends without a piece has the whole time as its first-token time and is marked degraded, so A37 can leave it out.
    """
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf[prompt]):
                start, first, parts, error = clock(), None, [], None
                try:
                    for piece in client(p):
                        first = clock() - start if first is None else first
                        parts.append(piece)
                except Exception as e:
                    error = type(e).__name__
                total = clock() - start
                out.append((k, "".join(parts), len(parts), total if first is None else first, total, first is None, error))
            yield pd.DataFrame(out, columns=[key, "text", "pieces", "ttft_s", "total_s", "degraded", "error"])

    return requests.select(key, prompt).mapInPandas(run, f"{key} {kind}, text string, pieces int, ttft_s double, total_s double, degraded boolean, error string")


def resume_calls(spark: SparkSession, state_path: str, names: list[str], spawn: Callable[[str], str], fetch: Callable[[str], str | None], attempts: int = 6, **retry) -> dict[str, str]:
    """One remote call a name; the state file keeps their ids, so a later run fetches what is in flight and spawns only the rest.

    ``fetch`` gives a result, or None while the call runs. A call that fails is spawned again, ``attempts`` times in all.
    """
    from tallyloom.sources.jsonl import read_sidecar

    done = {}
    for name in names:
        entry = read_sidecar(spark, state_path).get(name, {})
        tried = int(entry.get("attempts", 0))
        while "result" not in entry:
            if not entry.get("call"):
                if tried >= attempts:
                    raise RuntimeError(f"{name} failed {tried} times")
                tried += 1
                entry = {"call": str(with_retries(lambda n=name: spawn(n), **retry)), "attempts": tried}
                upsert_json(spark, state_path, name, entry)
            try:
                got = fetch(entry["call"])
            except Exception:
                entry = {"call": None, "attempts": tried}
                upsert_json(spark, state_path, name, entry)
                continue
            if got is None:
                break
            entry = entry | {"result": got}
            upsert_json(spark, state_path, name, entry)
        if "result" in entry:
            done[name] = entry["result"]
    return done


def label_session(rows: list[dict], ask: Callable[[dict], str], key: str = "pair_id") -> list[dict]:
    """Patches of a labelling session, for J9. ``ask`` shows a row and returns what was typed:
    "verdict [confidence] [notes]", "s" to skip, "k" to keep what is there, "c" to clear it, "q" to stop.
    """
    words = {"a": "A", "b": "B", "t": "TIE", "tie": "TIE"}
    out = []
    for row in rows:
        verdict = None
        while verdict is None:
            said = ask(row).strip()
            command = said.lower()
            if command == "q":
                return out
            if command in ("s", "k"):
                break
            if command == "c":
                out.append({key: row[key], "human_verdict": None, "confidence": None, "notes": None})
                break
            parts = said.split(None, 2)
            verdict = words.get(parts[0].lower()) if parts else None
            level = parts[1] if len(parts) > 1 else ""
            if verdict is None or level and level not in "12345":
                verdict = None  # asked again
                continue
            out.append({key: row[key], "human_verdict": verdict, "confidence": int(level) if level else None, "notes": parts[2] if len(parts) > 2 else None})
    return out


def suggestions(wanted: str, known: DataFrame, column: str = "model", most: int = 10) -> DataFrame:
    """J25/X6 for one id: at most ``most`` known ids that contain it, whatever its case, or its part before a slash."""
    maker = wanted.split("/")[0]
    test = F.contains(F.lower(F.col(column)), F.lit(wanted.lower())) | F.contains(F.col(column), F.lit(maker))
    return known.where((F.col(column) != wanted) & test).select(column).distinct().orderBy(column).limit(most)


def _pieces(c: Column, size: int = 3) -> Column:
    """The distinct runs of ``size`` characters of a string; of a shorter string itself."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))
    return F.array_distinct(runs)


def nearest(wanted: DataFrame, known: DataFrame, column: str, most: int = 10) -> DataFrame:
    """J25/X6 for a table of ids: (wanted, suggestion, place) of the ids in ``wanted[column]`` that ``known[column]`` lacks.

    A known id is suggested if it holds the wanted one, whatever the case, or its part before a slash. The first come
    first: whole before part, more shared runs of three characters, then by name; ``most`` at most each.

    Candidates come from an inverted index of the runs of one, two and three characters of the known ids: an id is looked up by
    the rarest run of what it must hold, so a run that all ids share is asked only where nothing rarer is known; nothing is
    compared with all ids. Ids that are known, and null ones, get no suggestion.
    """
    ids = known.select(F.col(column).alias("id")).where("id is not null").distinct().withColumn("low", F.lower("id"))
    misses = wanted.select(F.col(column).alias("wanted")).where("wanted is not null").distinct()
    misses = misses.join(ids.select("id"), F.col("wanted") == F.col("id"), "left_anti")
    postings = ids.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[_pieces(F.col("low"), k) for k in (1, 2, 3)])))).alias("run"))
    sizes = postings.groupBy("run").agg(F.count("*").alias("ids"))
    # What a suggestion must hold: the whole id, or its maker; each by its rarest run, and one without a posting finds nothing.
    maker = F.lower(F.substring_index("wanted", "/", 1))
    needles = misses.select("wanted", F.explode(F.array_distinct(F.array(F.lower("wanted"), maker))).alias("needle")).where("needle != ''")
    runs = needles.select("wanted", "needle", F.explode(_pieces(F.col("needle"))).alias("run")).join(sizes, "run", "left")
    rarest = runs.groupBy("wanted", "needle").agg(F.min(F.struct(F.coalesce("ids", F.lit(0)).alias("ids"), "run"))["run"].alias("run"))
    met = rarest.join(postings, "run").select("wanted", "id").distinct()
    whole = F.contains(F.lower("id"), F.lower("wanted"))
    met = met.where(whole | F.contains(F.col("id"), F.substring_index("wanted", "/", 1)))
    shared = F.size(F.array_intersect(_pieces(F.lower("wanted")), _pieces(F.lower("id"))))
    order = Window.partitionBy("wanted").orderBy(F.desc("whole"), F.desc("shared"), "suggestion")
    ranked = met.select("wanted", F.col("id").alias("suggestion"), whole.alias("whole"), shared.alias("shared"))
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("wanted", "suggestion", "place")


def chunk_plan(requests: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """Chunk numbers of the requests, without chunks that are done (and billed)."""
    from tallyloom.operators.sampling import chunks

    return chunks(requests, key, size).join(done.select("chunk").distinct(), "chunk", "left_anti")
