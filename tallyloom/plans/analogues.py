"""The engine's logical tables expressed on the driver's tables, for the registered queries.

question = orders, candidate = lineitem, label = labels with documents, prediction = hashes of (model, pass, document),
ledger = events, prompt and target = conversations. Each has a DataFrame form and a SQL form of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.hashing import hash32


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    level = F.when(c("l_returnflag") == "A", "neutral").when(c("l_returnflag") == "R", "biased").otherwise("unclear")
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("question"), F.concat_ws("::", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("int")).alias("key"),
        (c("l_suppkey") % 4).alias("model"), level.alias("level"), (c("l_linestatus") == "F").alias("hedged"), (c("l_linestatus") == "F").alias("uncertain"),
        c("l_quantity").alias("wc"),
    )


CAND = """(select l_orderkey as question, concat_ws('::', l_linenumber, l_partkey, l_suppkey, l_quantity::int) as key, l_suppkey % 4 as model,
  case l_returnflag when 'A' then 'neutral' when 'R' then 'biased' else 'unclear' end as level, l_linestatus = 'F' as hedged, l_linestatus = 'F' as uncertain,
  l_quantity as wc from lineitem)"""

PAIRS = f"""(select a.question, a.key as a_key, b.key as b_key, a.model as a_model, b.model as b_model,
  a.level = 'biased' and not a.hedged and b.level = 'neutral' and a.model <> b.model as in_clear,
  a.level = 'biased' and a.hedged and b.level = 'neutral' as in_subtle,
  a.level = 'biased' and b.level = 'unclear' as in_tracked,
  a.level = 'neutral' and b.level = 'neutral' and a.model <> b.model and a.key < b.key as in_tie,
  a.level = 'biased' and not a.hedged and b.level = 'neutral' and b.uncertain as in_confidence,
  a.level = 'biased' and b.level = 'neutral' and b.wc >= 5 and a.wc >= 2 * b.wc as in_length
  from {CAND} a join {CAND} b on a.question = b.question and a.key <> b.key)"""


def human(toxic: Column, quality: Column) -> Column:
    return F.when(toxic == 1, "B").when(quality == 1, "A").otherwise("TIE")


def truth(spark: SparkSession, d: str) -> DataFrame:
    """(pair, human, slice, category, confidence, len_a, len_b) of labelled documents."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source"), "doc_id")
    category = F.element_at(F.array(*[F.lit(x) for x in ("clear", "subtle", "tracked", "tie")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return j.select(
        F.col("doc_id").alias("pair"), human(F.col("toxic"), F.col("quality")).alias("human"),
        F.when(F.col("lang") == "en", "in_distribution").otherwise("held_out").alias("slice"), category.alias("category"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("confidence"), F.col("n_chars").alias("len_a"), (F.length("source") * 100).cast("long").alias("len_b"),
    )


TRUTH = """(select doc_id as pair, case when toxic = 1 then 'B' when quality = 1 then 'A' else 'TIE' end as human,
  case when lang = 'en' then 'in_distribution' else 'held_out' end as slice, (['clear', 'subtle', 'tracked', 'tie'])[doc_id % 4 + 1] as category,
  (doc_id % 5 + 1)::int as confidence, n_chars as len_a, length(source) * 100 as len_b from labels join documents using (doc_id))"""

MODELS = ("base", "tuned")


def _verdict(seed: Column, human_: Column) -> Column:
    h = hash32(seed) % 100
    return F.when(h < 5, "PARSE_FAIL").when(h < 65, human_).when(h < 75, "A").when(h < 88, "B").otherwise("TIE")


def _sql_verdict(seed: str, human_: str) -> str:
    h = f"(('0x' || substr(sha1({seed}), 1, 8))::bigint % 100)"
    return f"case when {h} < 5 then 'PARSE_FAIL' when {h} < 65 then {human_} when {h} < 75 then 'A' when {h} < 88 then 'B' else 'TIE' end"


def _flip(h: Column) -> Column:
    return F.when(h == "A", "B").when(h == "B", "A").otherwise("TIE")


def wide(spark: SparkSession, d: str) -> DataFrame:
    """``truth`` for each model with its plain and swapped verdicts."""
    t = truth(spark, d).withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    seed = lambda p: F.concat_ws("|", F.col("model"), F.lit(p), F.col("pair"))
    return t.withColumn("plain", _verdict(seed("plain"), F.col("human"))).withColumn("swapped", _verdict(seed("swapped"), _flip(F.col("human"))))


_FLIPPED = "case human when 'A' then 'B' when 'B' then 'A' else 'TIE' end"
WIDE = f"""(select *, {_sql_verdict("concat_ws('|', model, 'plain', pair)", "human")} as plain, {_sql_verdict("concat_ws('|', model, 'swapped', pair)", _FLIPPED)} as swapped
  from (select *, unnest(['base', 'tuned']) as model from {TRUTH}))"""


def sampled(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d).select("pair", "human").withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    t = t.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(4))))
    # Three runs in four repeat the first, so that consistency is neither 0 nor 1.
    shown = F.when(hash32(F.concat_ws("|", "model", F.lit("drift"), "pair")) % 4 == 0, F.col("run")).otherwise(0)
    return t.withColumn("verdict", _verdict(F.concat_ws("|", F.col("model"), F.lit("sample"), F.col("pair"), shown), F.col("human"))).drop("human")


SAMPLED = f"""(select pair, model, run, {_sql_verdict("concat_ws('|', model, 'sample', pair, shown)", "human")} as verdict from
  (select *, case when ('0x' || substr(sha1(concat_ws('|', model, 'drift', pair)), 1, 8))::bigint % 4 = 0 then run else 0 end as shown from
  (select *, unnest(range(0, 5))::int as run from (select pair, human, unnest(['base', 'tuned']) as model from {TRUTH}))))"""


def sql_kappa(h: str, m: str, where: str = "true") -> str:
    """Kappa of two SQL expressions over the rows of ``where``."""
    ok = f"({where}) and {h} in ('A','B','TIE') and {m} in ('A','B','TIE')"
    share = lambda t: f"avg(case when {ok} then ({t})::int end)"
    chance = " + ".join(f"{share(f'{h} = {chr(39)}{v}{chr(39)}')} * {share(f'{m} = {chr(39)}{v}{chr(39)}')}" for v in ("A", "B", "TIE"))
    return f"({share(f'{h} = {m}')} - ({chance})) / nullif(1 - ({chance}), 0)"


def dialogue(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, question, a, b, reasoning, verdict): a user turn, the next assistant turn and its successor in reverse."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    j = u.join(a, ["conv_id", "turn"])
    verdict = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("TIE")), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    return j.select(
        F.concat_ws("::", "conv_id", "turn").alias("pair_id"), "question", "a", F.col("question").alias("b"),
        F.concat(F.lit("<think>x</think>Response A says "), F.col("a"), F.lit(" but response B does not <confidence>4</confidence>")).alias("reasoning"),
        verdict.alias("verdict"), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int").alias("confidence"),
    )


DIALOGUE = """(select concat_ws('::', u.conv_id, u.turn) as pair_id, u.text as question, a.text as a, u.text as b,
  '<think>x</think>Response A says ' || a.text || ' but response B does not <confidence>4</confidence>' as reasoning,
  (['A', 'B', 'TIE'])[(u.conv_id + u.turn) % 3 + 1] as verdict, ((u.conv_id + u.turn) % 5 + 1)::int as confidence
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"""
