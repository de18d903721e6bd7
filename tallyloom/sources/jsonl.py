"""JSON-lines, sidecars and batch results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import rules
from tallyloom.sources.scratch import materialize

PART_ROWS = 250_000  # lines of a part of a log, which one task sorts


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank lines are skipped, a malformed line fails the query; the schema is given, so nothing is read twice."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines with their file)."""
    full = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_file"))
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = lines.select("_file", row.alias("r")).select("_file", "r.*")
    return raw.where("_corrupt is null").drop("_corrupt", "_file"), raw.where("_corrupt is not null").select("_file", "_corrupt")


def write_log(df: DataFrame, path: str, key: Column, line: Column, rows: int | None = None) -> None:
    """The lines of all rows in order of ``key``, in parts of about ``rows`` lines: each part is a range, sorted by a task of its own.

    The parts' names have the order of their ranges, so ``numbered_lines(..., through=True)`` numbers the whole log.
    """
    parts = -(-df.count() // (rows or PART_ROWS))
    df.repartitionByRange(max(1, parts), key).sortWithinPartitions(key).select(line.alias("value")).write.text(path)


def numbered_lines(spark: SparkSession, path: str, keep=lambda line: F.lit(True), through: bool = False) -> DataFrame:
    """(file, line, text) of the lines of text files that ``keep`` holds, numbered from 1 in their file; files are read in splits.

    With ``through`` the files are parts of one log: numbers go on from file to file, in the order of their names.
    A split's lines are counted where they are read; prefix sums of these counts, a row a split, number the kept lines. What is
    written meanwhile is a few bytes a line and the text of kept ones. A line ends with a line feed; blank lines count.
    """
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(m["file_path"].alias("file"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    # Places are written once, so no second reading can cut the files otherwise.
    marked = materialize(lines.select("file", "split", "at", F.when(keep(F.col("value")), F.col("value")).alias("text")), "lines")
    splits = marked.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto = F.sum("n").over(Window.orderBy("file", "split") if through else Window.partitionBy("file").orderBy("split"))
    splits = splits.select("file", "split", (upto - F.col("n") - F.col("first") + 1).alias("shift"))
    return marked.where("text is not null").join(splits, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "text")


def malformed_lines(spark: SparkSession, path: str, schema: str, through: bool = False) -> DataFrame:
    """S3: (file, line, text) of the lines that don't fit, numbered from 1; blank lines are no rows but count as lines."""
    full = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    row = lambda line: F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return numbered_lines(spark, path, lambda line: (F.trim(line) != "") & row(line)["_corrupt"].isNotNull(), through)


def read_guarded(spark: SparkSession, path: str, needs: str) -> DataFrame:
    """A table that an earlier step must have made."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run {needs} first")
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """One split of a table that is partitioned by it; the others' files are not listed for reading."""
    return spark.read.parquet(path).where(F.col(column) == value).drop(column)


def probe_rows(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of a fixed list of ids; an id without a row is an error."""
    rows = df.where(F.col(key).isin(ids))
    missing = set(ids) - {r[key] for r in rows.select(key).distinct().collect()}  # as many as the list
    if missing:
        raise KeyError(f"probe ids without a row: {sorted(missing)}")
    return rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def key_set(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(distinct keys as strings, rows without one)."""
    keys = df.select(F.col(key).cast("string").alias(key))
    return keys.where(F.col(key).isNotNull()).distinct(), keys.where(F.col(key).isNull()).count()


def _fs(spark: SparkSession, path: str):
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(hadoop), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_sidecar(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """One small JSON object, from any store Spark reads; ``default`` where there is none."""
    if not exists(spark, path):
        return {} if default is None else default
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def labelled_eval(df: DataFrame, label: str = "human_verdict") -> DataFrame:
    """A null label or an empty input fails the query."""
    if df.isEmpty():
        raise ValueError("no evaluation records")
    first = df.columns[0]
    bad = F.raise_error(F.lit(f"{label} is null")).cast(df.schema[first].dataType)
    return df.withColumn(first, F.when(F.col(label).isNotNull(), F.col(first)).otherwise(bad))


RESULT = "custom_id string, status string, text string, usage map<string,bigint>, error string, stop_reason string"

_MESSAGE = (
    "custom_id string, result struct<type: string, error: struct<type: string, message: string>, message: struct<stop_reason: string,"
    " content: array<struct<type: string, text: string>>, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint,"
    " cache_creation_input_tokens: bigint>>>"
)
_CHAT = (
    "custom_id string, error struct<message: string>, response struct<status_code: int, body: struct<error: struct<message: string>,"
    " choices: array<struct<finish_reason: string, message: struct<content: string> > >,"
    " usage: struct<prompt_tokens: bigint, completion_tokens: bigint, prompt_tokens_details: struct<cached_tokens: bigint> > > >"
)


def message_results(lines: DataFrame) -> DataFrame:
    """Batch results whose message is a list of blocks. ``lines``: a JSON text a row, in ``value``."""
    r = lines.where(F.trim("value") != "").select(F.from_json("value", _MESSAGE).alias("r")).select("r.*")
    u = "result.message.usage."
    usage = rules.usage_map(**{k: F.col(u + k) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")})
    return r.select(
        "custom_id", F.col("result.type").alias("status"), F.when(F.col("result.type") == "succeeded", rules.text_blocks(F.col("result.message.content"))).alias("text"),
        usage.alias("usage"), F.col("result.error.message").alias("error"), F.col("result.message.stop_reason").alias("stop_reason"),
    )


def chat_results(output: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """S11 (with an error file) and S12 (without): results whose body has choices; an error is named in any of three places."""
    parse = lambda d: d.where(F.trim("value") != "").select(F.from_json("value", _CHAT).alias("r")).select("r.*")
    r = parse(output) if errors is None else parse(output).unionByName(parse(errors))
    c = F.col
    error = F.coalesce(c("error.message"), c("response.body.error.message"), F.when(c("response.status_code") >= 400, F.concat(F.lit("http "), c("response.status_code"))))
    first = F.get("response.body.choices", 0)
    u = "response.body.usage."
    usage = rules.usage_map(prompt_tokens=c(u + "prompt_tokens"), completion_tokens=c(u + "completion_tokens"), cached_tokens=c(u + "prompt_tokens_details.cached_tokens"))
    return r.select(
        "custom_id", F.when(error.isNull(), "succeeded").otherwise("errored").alias("status"), F.when(error.isNull(), first["message"]["content"]).alias("text"),
        usage.alias("usage"), error.alias("error"), first["finish_reason"].alias("stop_reason"),
    )
