"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

1. A source's size is its number of words. Sources in code-point order (null last) take the weights
   in turn and share ``share`` times all words; a source stops at ``cap`` times its size and its excess
   is dealt again by weight. The fixed point is computed at once: with sources in order of
   cap / weight, those that fill up are a prefix, and every other source gets the same words a weight.
2. A document's expected copies are target / size of its source times its importance (1 by default,
   any positive column otherwise): the whole part is certain, the fraction is its inclusion probability p.
3. A uniform u per document, from a hash, gives the rank Q = (u / (1 - u)) / (p / (1 - p)). In each source
   documents are taken in order of Q until the words left after the certain copies are filled; the document
   that crosses the line is taken if that brings the source nearer to its target, so a source misses by half
   a document at most. With equal importance p is the same inside a source and differs between sources.
   Rows of equal rank, size and id are counted, and as many of them are taken as fit.

No source is gathered in one task: the place of the cut is found by a histogram of Q over ``BINS`` bins a
source, then over ``BINS`` parts of the one bin that holds the cut; only documents in that part (about a
millionth of the source) are put in order. Every histogram is summed before its shuffle.

Defined cases: null text has no words and takes none; a source without words has target 0; rows that are equal in
id, source and size have equal ranks: where the line falls between them the exact number is taken, by place of the row
in its input partition; rows without an id are told apart by a hash of their text; an empty table gives an empty result.
Further columns pass through, but for those whose names start with ``mix_`` or ``cut_``, which are dropped. The result depends on rows and seed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, materialize, word_count

BINS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes``: (mix_source, mix_source_size), a row a source -> the same with mix_target."""
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("mix_w", w).withColumn("mix_cap", F.lit(cap) * F.col("mix_source_size"))
    fill = Window.orderBy(F.col("mix_cap") / F.col("mix_w"), F.col("mix_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    left = F.lit(share) * F.sum("mix_source_size").over(whole) - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))
    t = t.withColumn("mix_level", left / F.sum("mix_w").over(rest))
    t = t.withColumn("mix_level", F.max("mix_level").over(whole))
    target = F.round(F.least("mix_cap", F.col("mix_w") * F.col("mix_level")), 6)
    return t.select("mix_source", "mix_source_size", target.alias("mix_target"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash; null parts count as a mark of their own."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return (F.conv(F.substring(F.sha1(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    importance: Column | None = None,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target (its source's) and mix_copies (int)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith(("mix_", "cut_"))])
    base = docs.select(
        "*",
        word_count("text").alias("mix_size"),
        F.col("source").alias("mix_source"),
        (F.lit(1.0) if importance is None else importance.cast("double")).alias("mix_imp"),
    )
    name = F.when(F.col("doc_id").isNull(), F.concat(F.lit("\\N"), F.md5(F.coalesce("text", F.lit(""))))).otherwise(F.col("doc_id").cast("string"))
    base = base.withColumn("mix_u", uniform(seed, F.col("source"), name, F.col("mix_size")))
    thin = materialize(base.select(F.col("doc_id").alias("mix_id"), "mix_source", "mix_size", "mix_imp", "mix_u"), "mix-thin")
    sums = thin.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"), F.sum(F.col("mix_size") * F.col("mix_imp")).alias("mix_imp_size"))
    sums = materialize(sums, "mix-sums")
    targets = source_targets(sums.select("mix_source", "mix_source_size"), weights, share, cap)
    plan = sums.select(F.col("mix_source").alias("s"), "mix_imp_size").join(targets, F.col("s").eqNullSafe(F.col("mix_source")))
    rate = F.coalesce(F.try_divide("mix_target", "mix_imp_size"), F.lit(0.0))
    plan = materialize(plan.select("mix_source", "mix_source_size", "mix_target", rate.alias("mix_rate")), "mix-plan")

    copies = F.least(F.lit(cap), F.col("mix_rate") * F.col("mix_imp"))
    sure = F.floor(copies).cast("long")
    p = copies - sure
    odds = F.when(p > 0, (F.col("mix_u") / (1 - F.col("mix_u"))) / (p / (1 - p)))
    place = F.col("mix_q") / (1 + F.col("mix_q"))

    def ranked(df: DataFrame) -> DataFrame:
        right = plan.withColumnRenamed("mix_source", "mix_plan_source")
        df = df.join(right, F.col("mix_source").eqNullSafe(F.col("mix_plan_source")), "left").drop("mix_plan_source")
        df = df.withColumn("mix_sure", sure).withColumn("mix_q", odds)
        df = df.withColumn("mix_place", place * BINS).withColumn("mix_bin", F.floor("mix_place").cast("int"))
        return df.withColumn("mix_part", F.floor((F.col("mix_place") - F.col("mix_bin")) * BINS).cast("int"))

    r = ranked(thin)
    need = r.groupBy("mix_source").agg((F.max("mix_target") - F.sum(F.col("mix_sure") * F.col("mix_size"))).alias("mix_need"))

    def cut(hist: DataFrame, key: str) -> DataFrame:
        """The bin in which the need of each source is met, and the words before it; the last bin if none."""
        w = Window.partitionBy("mix_source").orderBy(key)
        upto = F.sum("words").over(w)
        h = hist.withColumn("before", upto - F.col("words")).withColumn("after", upto)
        h = h.withColumn("last", F.max(key).over(Window.partitionBy("mix_source")))
        hit = (F.col("after") >= F.col("mix_need")) | (F.col(key) == F.col("last"))
        return h.where(hit).groupBy(F.col("mix_source").alias("cut_source"), "mix_need").agg(F.min(F.struct(key, "before")).alias("c")).select(
            "cut_source", F.col(f"c.{key}").alias(f"cut_{key}"), (F.col("mix_need") - F.col("c.before")).alias("cut_need")
        )

    able = F.col("mix_q").isNotNull()
    hist = r.where(able).groupBy("mix_source", "mix_bin").agg(F.sum("mix_size").alias("words"))
    hist = hist.join(need.withColumnRenamed("mix_source", "n"), F.col("mix_source").eqNullSafe(F.col("n"))).drop("n")
    first = materialize(cut(hist, "mix_bin"), "mix-cut")
    inside = r.where(able).join(first, F.col("mix_source").eqNullSafe(F.col("cut_source")) & (F.col("mix_bin") == F.col("cut_mix_bin"))).drop("cut_source")
    parts = inside.groupBy("mix_source", "mix_part", F.col("cut_need").alias("mix_need")).agg(F.sum("mix_size").alias("words"))
    second = cut(parts, "mix_part").toDF("cut_source2", "cut_mix_part", "cut_need2")
    inside = inside.join(second, F.col("mix_source").eqNullSafe(F.col("cut_source2")) & (F.col("mix_part") == F.col("cut_mix_part")))
    ties = inside.groupBy("mix_source", "mix_q", "mix_size", "mix_id").agg(F.count("*").alias("mix_n"), F.first("cut_need2").alias("mix_need"))
    order = Window.partitionBy("mix_source").orderBy("mix_q", "mix_size", F.col("mix_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.col("mix_n") * F.col("mix_size")).over(order), F.lit(0))
    fit = F.floor(F.try_divide(F.col("mix_need") - upto + F.col("mix_size") / 2, F.col("mix_size")))
    ties = ties.withColumn("mix_fit", F.greatest(F.lit(0), F.least("mix_n", F.coalesce(fit, F.col("mix_n")))))
    last = F.struct("mix_q", "mix_size", F.coalesce("mix_id", F.lit(2**63 - 1)).alias("mix_id"))
    line = ties.where("mix_fit > 0").groupBy(F.col("mix_source").alias("cut_source")).agg(F.max(F.struct(last.alias("at"), "mix_fit", "mix_n")).alias("m"))
    line = line.select("cut_source", F.col("m.at").alias("mix_line"), F.col("m.mix_fit").alias("cut_fit"), F.col("m.mix_n").alias("cut_n"))
    line = first.select("cut_source", "cut_mix_bin").join(second.select(F.col("cut_source2").alias("c2"), "cut_mix_part"), F.col("cut_source").eqNullSafe(F.col("c2"))).join(
        line.withColumnRenamed("cut_source", "c3"), F.col("cut_source").eqNullSafe(F.col("c3")), "left"
    ).select("cut_source", "cut_mix_bin", "cut_mix_part", "mix_line", "cut_fit", "cut_n")
    line = materialize(line, "mix-line")

    out = ranked(base).join(line, F.col("mix_source").eqNullSafe(F.col("cut_source")), "left")
    here = F.struct("mix_q", "mix_size", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("mix_id"))
    part = (F.col("mix_bin") == F.col("cut_mix_bin")) & (F.col("mix_part") == F.col("cut_mix_part"))
    extra = F.when(F.col("mix_q").isNull() | F.col("cut_mix_bin").isNull(), False).otherwise(
        (F.col("mix_bin") < F.col("cut_mix_bin"))
        | ((F.col("mix_bin") == F.col("cut_mix_bin")) & (F.col("mix_part") < F.col("cut_mix_part")))
        | (part & F.coalesce(here <= F.col("mix_line"), F.lit(False)))
    )
    out = out.withColumn("mix_extra", extra)
    if not line.where("cut_fit < cut_n").isEmpty():
        # The line falls between equal rows of some source: these are counted by input partition, and the first that fit are taken.
        split = F.coalesce((F.col("cut_fit") < F.col("cut_n")) & part & (here == F.col("mix_line")), F.lit(False))
        edge = materialize(out.where(split).withColumn("cut_slot", F.monotonically_increasing_id()), "mix-edge")
        edge = edge.withColumn("cut_task", F.shiftright("cut_slot", 33))
        tasks = edge.groupBy(F.col("mix_source").alias("s"), F.col("cut_task").alias("t")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = edge.join(tasks.select("s", "t", before.alias("cut_before")), F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("cut_task") == F.col("t")))
        nth = F.row_number().over(Window.partitionBy("mix_source", "cut_task").orderBy("cut_slot"))
        edge = edge.withColumn("mix_extra", F.col("cut_before") + nth <= F.col("cut_fit"))
        out = out.where(~split).unionByName(edge.select(*out.columns))
    out = out.withColumn("mix_copies", F.coalesce(F.col("mix_sure"), F.lit(0).cast("long")) + F.col("mix_extra").cast("long"))
    discard(thin)
    return out.select(*docs.columns, "mix_size", F.coalesce("mix_source_size", F.lit(0).cast("long")).alias("mix_source_size"), F.coalesce("mix_target", F.lit(0.0)).alias("mix_target"), "mix_copies")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row a copy: the mix itself."""
    return mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*columns)


ORACLE = r"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(text, '')) as mark
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w,
         2.0::double * source_size as cap
  from s),
l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(w) over (order by cap / w, source asc nulls last rows between current row and unbounded following) as level
  from w),
t as (select source, source_size, round(least(cap, w * max(level) over ()), 6) as target from l),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t),
q as (
  select d.doc_id, d.source, d.size, r.source_size, r.target, least(2.0::double, r.rate) as copies,
         floor(least(2.0::double, r.rate))::bigint as sure,
         (('0x' || substr(sha1('17|' || coalesce(d.source, '\N') || '|' || coalesce(d.doc_id::varchar, '\N' || d.mark) || '|' || d.size), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from d join r on d.source is not distinct from r.source),
o as (
  select *, case when copies - sure > 0 then (u / (1 - u)) / ((copies - sure) / (1 - (copies - sure))) end as odds,
         target - sum(sure * size) over (partition by source) as need
  from q),
k as (
  select *, case when odds is null then false
                 else sum(size) over (partition by source, odds is null order by odds, size, doc_id nulls last rows between unbounded preceding and current row) - size / 2 <= need end as extra
  from o)
select doc_id, size, source_size, target, (sure + extra::bigint) * size as taken from k
"""
