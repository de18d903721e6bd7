"""Pair construction inside groups: pools as predicates, one self-join, prioritised first-wins sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import coin, hash_order, pair_id
from tallyloom.sources.scratch import materialize

FLOOR, RATIO = 5, 2.0
#: Rows of a question in one part; a larger question is dealt to several. FEW questions are broadcast, more are shuffled.
UNIT, FEW = 2_000, 100_000


@dataclass(frozen=True)
class Pool:
    """A bucket: which ordered pairs (a, b) of a group belong to it."""

    name: str
    ordered: bool  # an ordered pool takes (a, b) by role, else once for both orders

    def test(self, a, b) -> Column:
        biased, neutral = a("level") == "biased", b("level") == "neutral"
        other = a("model") != b("model")
        return {
            "clear": biased & ~a("hedged") & neutral & other,
            "subtle": biased & a("hedged") & neutral,
            "tracked": biased & (b("level") == "unclear"),
            "tie": (a("level") == "neutral") & neutral & other & (a("key") < b("key")),
            "length": biased & neutral & (b("wc") >= FLOOR) & (a("wc") >= RATIO * b("wc")),
            "confidence": biased & ~a("hedged") & neutral & b("uncertain"),
        }[self.name]


#: J3-J8 in order of priority; confidence goes before length.
POOLS = [Pool("clear", True), Pool("subtle", True), Pool("tracked", True), Pool("tie", False), Pool("confidence", True), Pool("length", True)]


def _dealt(base: DataFrame, unit: int) -> DataFrame:
    """``base`` with the number of parts of the row's question and the row's part; questions of up to ``unit`` rows have one part."""
    hot = base.groupBy("question").agg(F.count("*").alias("_n")).where(F.col("_n") > unit)
    hot = materialize(hot.select(F.col("question").alias("_hot"), F.ceil(F.col("_n") / unit).cast("int").alias("_k")), "hot-questions")
    few = hot.count()
    if not few:
        return base.withColumn("_k", F.lit(1)).withColumn("_part", F.lit(0))
    hot = F.broadcast(hot) if few <= FEW else hot.hint("shuffle_hash")
    j = base.join(hot, F.col("question") == F.col("_hot"), "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    return j.select(*base.columns, "_k", F.pmod(F.xxhash64("key"), F.col("_k")).cast("int").alias("_part"))


def candidate_pairs(cands: DataFrame, pools: list[Pool] = POOLS, unit: int = UNIT) -> DataFrame:
    """One equi-self-join for all pools: (question, a_key, b_key, a_model, b_model, in_<pool> flags).

    ``cands``: question, key (unique in the question), model, level, hedged, uncertain, wc. Only columns the predicates
    need take part in the shuffle. The rows of a large question are dealt to k parts, and each pair of parts is a key of its
    own: a row is sent k times, and a task meets ``unit`` times ``unit`` rows instead of the whole square.
    """
    base = cands.select("question", "key", "model", "level", "hedged", "uncertain", "wc").where("level <> 'excluded'")
    base = _dealt(base, unit)
    every = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    cell = {"a": [F.col("_part").alias("_i"), every.alias("_j")], "b": [every.alias("_i"), F.col("_part").alias("_j")]}
    side = lambda p: base.select("question", *cell[p], *[F.col(c).alias(f"{p}_{c}") for c in base.columns[1:-2]])
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    joined = side("a").join(side("b"), ["question", "_i", "_j"]).where(F.col("a_key") != F.col("b_key"))
    joined = joined.select("question", "a_key", "b_key", "a_model", "b_model", *[F.coalesce(p.test(a, b), F.lit(False)).alias(f"in_{p.name}") for p in pools])
    any_pool = F.lit(False)
    for p in pools:
        any_pool = any_pool | F.col(f"in_{p.name}")
    return joined.where(any_pool)


def pool_pairs(cands: DataFrame, name: str) -> DataFrame:
    """One pool alone, its side filters pushed below the join."""
    pool = next(p for p in POOLS if p.name == name)
    return candidate_pairs(cands, [pool]).select("question", "a_key", "b_key", "a_model", "b_model")


def measure_pools(pairs: DataFrame, pools: list[Pool] = POOLS) -> DataFrame:
    """The sizes of all pools in one pass."""
    return pairs.agg(*[F.count_if(F.col(f"in_{p.name}")).alias(p.name) for p in pools])


def pool_sizes(cands: DataFrame) -> DataFrame:
    """A8 without any pair: the sizes of all pools from counts by question and model and, for J7, from running counts by length.

    ``cands`` as in ``candidate_pairs``, keys unique in their question; nulls count as they do there. Counts are combined before
    they are shuffled, so a hot question is a few rows a task.
    """
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    c = F.col
    biased, neutral = c("level") == "biased", c("level") == "neutral"
    base = cands.where("key is not null and question is not null")
    by_model = base.groupBy("question", "model").agg(
        is_(biased).alias("b"), is_(biased & ~c("hedged")).alias("plain"), is_(biased & c("hedged")).alias("hedged"),
        is_(neutral).alias("n"), is_(neutral & c("uncertain")).alias("unsure"), is_(c("level") == "unclear").alias("unclear"),
    )
    named = lambda x: F.sum(F.when(c("model").isNotNull(), x))
    q = by_model.groupBy("question").agg(
        (named(c("plain")) * named(c("n")) - named(c("plain") * c("n"))).alias("clear"),
        (F.sum("hedged") * F.sum("n")).alias("subtle"), (F.sum("b") * F.sum("unclear")).alias("tracked"),
        F.expr("(sum(if(model is not null, n, 0)) * sum(if(model is not null, n, 0)) - sum(if(model is not null, n * n, 0))) div 2").alias("tie"),
        (F.sum("plain") * F.sum("unsure")).alias("confidence"),
    )
    # A neutral row stands where its longer partner must be at least; biased rows from there on are counted.
    place = F.when(biased, c("wc").cast("double")).when(neutral & (c("wc") >= FLOOR), RATIO * c("wc"))
    at = base.select("question", place.alias("place"), biased.alias("biased")).where("place is not null")
    at = at.groupBy("question", "place").agg(F.count_if("biased").alias("b"), F.count_if(~c("biased")).alias("n"))
    longer = F.sum("b").over(Window.partitionBy("question").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, 0))
    length = at.withColumn("longer", longer).agg(F.coalesce(F.sum(c("longer") * c("n")), F.lit(0)).alias("length"))
    names = ["clear", "subtle", "tracked", "tie", "confidence"]
    return q.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names]).crossJoin(F.broadcast(length))  # one row each


def sample_pairs(pairs: DataFrame, targets: dict[str, int], seed: object, per_question: int, seen: DataFrame | None = None, pools: list[Pool] = POOLS) -> DataFrame:
    """Buckets in order of priority; a pair id once over all buckets; at most ``per_question`` of a question in a bucket.

    Each bucket: anti-join what is picked, the first row of each pair id, the first rows of each question, the first
    ``target`` in question-major hash order (a top-n, no sort of the whole). Picked rows are bounded by the targets.

    Order is question-major, so only the first questions in hash order count: a share of them that should hold all targets
    is read (the cut reaches both sides of the join that made the pairs), and a larger one if it turns out too small.
    """
    base = pairs.withColumn("pair_id", pair_id(F.col("question").cast("string"), F.col("a_model").cast("string"), F.col("b_model").cast("string")))
    base = base.withColumn("_q", hash_order(seed, F.col("question"))).withColumn("_p", hash_order(seed, F.col("question"), F.col("a_key"), F.col("b_key")))
    wanted = {p.name: targets[p.name] for p in pools if targets.get(p.name, 0) > 0}
    below = lambda s: base if s >= 1 else base.where(F.col("_q") < format(int(s * 2**32), "08x"))
    share = 1 / 64
    seen_now = below(share).agg(*[F.count_if(F.col(f"in_{n}")).alias(n) for n in wanted]).first() if wanted else {}
    share = min(1.0, share * max([4 * t / seen_now[n] if seen_now[n] else 64 for n, t in wanted.items()], default=1))
    while True:
        out, short = _first_wins(materialize(below(share), "pairs"), targets, per_question, seen, pools)
        if not short or share >= 1:
            break
        share = min(1.0, 8 * share)
    flip = coin(seed, F.col("pair_id"))
    swap = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return out.select(
        "bucket", "question", "pair_id", swap("a_key", "b_key").alias("a_key"), swap("b_key", "a_key").alias("b_key"),
        swap("a_model", "b_model").alias("a_model"), swap("b_model", "a_model").alias("b_model"),
    )


def _first_wins(base: DataFrame, targets: dict[str, int], per_question: int, seen: DataFrame | None, pools: list[Pool]) -> tuple[DataFrame, bool]:
    """(picked rows with their bucket, whether some target was not reached)."""
    short = False
    taken = seen.select("pair_id") if seen is not None else None
    out: DataFrame | None = None
    for pool in pools:
        if targets.get(pool.name, 0) <= 0:
            continue
        rows = base.where(F.col(f"in_{pool.name}")).select("question", "a_key", "b_key", "a_model", "b_model", "pair_id", "_q", "_p")
        if taken is not None:
            rows = rows.join(taken, "pair_id", "left_anti")
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id").orderBy("_q", "_p"))).where("_n = 1")
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy("_q", "_p"))).where(F.col("_n") <= per_question)
        rows = rows.orderBy("_q", "_p").limit(targets[pool.name]).withColumn("bucket", F.lit(pool.name)).drop("_n")
        rows = materialize(rows, "picked")
        short = short or rows.count() < targets[pool.name]
        out = rows if out is None else out.unionByName(rows)
        taken = rows.select("pair_id") if taken is None else taken.union(rows.select("pair_id"))
    if out is None:
        out = base.limit(0).withColumn("bucket", F.lit("")).select("question", "a_key", "b_key", "a_model", "b_model", "pair_id", "_q", "_p", "bucket")
    return out, short


def diagnostics(picked: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Target, achieved, cross-model and same-model pairs by bucket, zero-filled."""
    spec = picked.sparkSession.createDataFrame(sorted(targets.items()), "bucket string, target long")
    got = picked.groupBy("bucket").agg(F.count("*").alias("achieved"), F.count_if(F.col("a_model") != F.col("b_model")).alias("cross"), F.count_if(F.col("a_model") == F.col("b_model")).alias("same"))
    return spec.join(got, "bucket", "left").na.fill(0, ["achieved", "cross", "same"])


def dynamic_caps(base: dict[str, int], split: dict[str, int], pools: dict[str, int], rate: float) -> tuple[dict[str, int], dict[str, int]]:
    """Heuristic buckets get at most a share of their pools (half-even), the adversarial split shrinks to its ceiling."""
    share = lambda name: round(rate * pools.get(name, 0))
    targets = base | {"subtle": min(base["subtle"], share("subtle"))}
    parts = {k: min(split[k], share(k)) for k in ("length", "confidence")}
    wanted = sum(parts.values())
    targets["adversarial"] = min(base.get("adversarial", wanted), wanted)
    if targets["adversarial"] < wanted:
        parts["length"] = round(parts["length"] * targets["adversarial"] / wanted)
        parts["confidence"] = targets["adversarial"] - parts["length"]
    return targets, parts
