"""Quality rules as a learned decision list (DataFrame operations only).

1. Statistics of a text come from built-in functions over its whole length (``statistics``).
2. ``learn``: sequential covering over labelled statistics. Thresholds are quantiles of each feature. A rule is
   a conjunction of thresholds against the bad class: it grows on two thirds of the rows by the condition of
   the largest information gain (FOIL), then drops conditions from the end while that doesn't hurt
   (p - n) / (p + n) on the other third. Rules are added, the rows they cover leave, until a rule is no longer
   right nine times in ten on the pruning rows ((p - n) / (p + n) above 0.8). Every step is one aggregation of counts by feature and bin; the driver
   sees these sums, of at most features x bins rows, and no row of the data.
3. ``expression``: the list as an ordered conditional expression.

Bound: ``most`` labelled rows (in order of a hash of the id) are learned from. The rows' bins are kept in a table.

Defined cases: null and empty text: all statistics 0 (so the base rule fails it); without labels, or of one class
only, the list is empty and keeps what the base rule keeps; repeated rows are judged one by one; a null doc_id
is judged as any other; ``judge`` ignores further columns; ``statistics`` replaces columns whose names start with ``stat_``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, labelled_sample, let, materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: The features the rules may test; all are defined for empty texts.
FEATURES = {
    "n_words": "stat_n_words",
    "mean_word": "try_divide(stat_word_chars, stat_n_words)",
    "symbol_share": "try_divide(stat_n_symbols, stat_word_chars)",
    "repeat_share": "try_divide(stat_n_repeat_words, stat_n_words)",
    "dup_lines": "stat_n_dup_lines",
    "upper_share": "try_divide(stat_n_upper, stat_word_chars)",
    "mark_share": "try_divide(stat_n_marks, stat_word_chars)",
    "digit_share": "try_divide(stat_n_digits, stat_word_chars)",
    "line_words": "try_divide(stat_n_words, stat_n_lines)",
}


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the stat_ columns (long).

    All are made in one expression whose parts are bound once (``let``), and leave it through a generator: a consumer's filter
    stays above it and never repeats the work.
    """
    zero = F.lit(0).cast("long")
    long = lambda c: c.cast("long")

    def repeats(words: Column) -> Column:
        """Words inside three-word windows that occur twice."""

        def placed(p: Column) -> Column:
            same = lambda x, j: x["w"].eqNullSafe(F.get(p, j)["w"])
            met = F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))
            # Windows are three long: each adds what lies beyond the one before it.
            step = lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"))
            begin = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
            return F.aggregate(F.sort_array(F.transform(met, lambda x: x["i"])), begin, step, lambda acc: long(acc["n"]))

        def windows(w: Column) -> Column:
            # Only a text with a window met twice needs the windows' places.
            places = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
            return F.when(F.size(w) > F.size(F.array_distinct(w)), let(places, placed)).otherwise(zero)

        n = F.size(words)
        triple = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat_ws("\n", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
        return F.when(n >= 4, let(triple, windows)).otherwise(zero)

    def all_of(t: Column) -> Column:
        count = lambda p: long(F.regexp_count(t, F.lit(p)))
        words = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(long(F.size(w)).alias("n"), repeats(w).alias("r")))
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        lines = let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("d")))
        return F.struct(
            words.alias("w"), lines.alias("l"), long(F.length(F.regexp_replace(t, SPACE, ""))).alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
            count(r"\p{Lu}").alias("n_upper"), count(r"[!?]").alias("n_marks"), count(r"[0-9]").alias("n_digits"),
        )

    d = docs.drop(*[c for c in docs.columns if c.lower().startswith("stat_")])
    made = F.transform(F.array(F.coalesce("text", F.lit(""))), all_of)
    d = d.select("*", F.explode_outer(made).alias("stat_all"))
    return d.select(
        *[c for c in d.columns if c != "stat_all"], F.col("stat_all.w.n").alias("stat_n_words"), F.col("stat_all.w.r").alias("stat_n_repeat_words"),
        F.col("stat_all.l.n").alias("stat_n_lines"), F.col("stat_all.l.d").alias("stat_n_dup_lines"),
        *[F.col(f"stat_all.{c}").alias(f"stat_{c}") for c in ("word_chars", "n_symbols", "n_upper", "n_marks", "n_digits")],
    )


def base_failed() -> Column:
    return (F.col("stat_n_words") < 50) | (100 * F.col("stat_n_repeat_words") > 50 * F.col("stat_n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        x = F.coalesce(F.expr(FEATURES[self.feature]).cast("double"), F.lit(0.0))
        return x > self.value if self.above else x <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rules = list[list[Condition]]


def expression(rules: Rules) -> Column:
    """True for what the list keeps."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, False).otherwise(out)
    return out


def _binned(rows: DataFrame, bins: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """Labelled rows with one bin number a feature: how many of its thresholds lie below the value."""
    values = {f: F.coalesce(F.expr(e).cast("double"), F.lit(0.0)).alias(f) for f, e in FEATURES.items()}
    rows = rows.select("doc_id", "y", *values.values())
    # Half of the thresholds from all rows, half from the rare class, whose values may be the tail of all.
    at = [i / (bins // 2) for i in range(bins // 2)]
    rare = lambda f: F.when(F.col("y") == 0, F.col(f))
    cuts = rows.agg(*[F.percentile_approx(f, at, 2000).alias(f) for f in FEATURES], *[F.percentile_approx(rare(f), at, 2000).alias(f"r_{f}") for f in FEATURES]).first()
    edges = {f: sorted(set(cuts[f] or []) | set(cuts[f"r_{f}"] or [])) for f in FEATURES}
    number = {f: sum((F.when(F.col(f) > v, 1).otherwise(0) for v in edges[f]), F.lit(0)).alias(f"b_{f}") for f in FEATURES}
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3))
    return rows.select("y", (part < 2).alias("grow"), *number.values()), edges


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held: int = 0, most: int = 8_000, bins: int = 40, rules: int = 8, conditions: int = 3) -> Rules:
    """The ordered rules that reject. The held-out fold (crc32 of the id) is never learned from."""
    sample = labelled_sample(docs, labels, target, folds, held, most)
    stats = statistics(sample)
    stats = materialize(stats.select("doc_id", "y", *[c for c in stats.columns if c.startswith("stat_")]), "labelled-stats")
    rows, edges = _binned(stats, bins)
    names = [f"b_{f}" for f in FEATURES]
    # Equal bins count together: what is left is at most one row a labelled row.
    table = materialize(rows.groupBy("grow", *names).agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")), "labelled-bins")
    table = table.coalesce(1)

    def test(c: Condition) -> Column:
        k = edges[c.feature].index(c.value)
        return F.col(f"b_{c.feature}") > k if c.above else F.col(f"b_{c.feature}") <= k

    def all_of(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & test(c)
        return out

    def sums(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("p"), F.coalesce(F.sum("good"), F.lit(0)).alias("n")).first()
        return int(r["p"]), int(r["n"])

    long = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES]))
    left, found = table, []
    for _ in range(rules):
        grow = left.where("grow")
        rule: list[Condition] = []
        p0, n0 = sums(grow)
        while len(rule) < conditions and p0 and n0:
            got = grow.where(all_of(rule)).select("good", "bad", long.alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum("good").alias("n")).collect()
            best, gain = None, 0.0
            for f in FEATURES:
                counts = {r["b"]: (r["p"], r["n"]) for r in got if r["f"] == f}
                for k, v in enumerate(edges[f]):
                    hi = [sum(c[i] for b, c in counts.items() if b > k) for i in (0, 1)]
                    for above, (p, n) in ((True, hi), (False, (p0 - hi[0], n0 - hi[1]))):
                        g = p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1))) if p else 0.0
                        # Of equal gains of one feature the tightest condition is taken: it rejects least.
                        tighter = best is not None and above and best.above and best.feature == f and abs(g - gain) < 1e-9
                        if g > gain + 1e-9 or tighter and g > 0:
                            best, gain, now = Condition(f, above, v), g, (p, n)
            if best is None:
                break
            rule.append(best)
            p0, n0 = now
        prune = left.where("not grow")
        worth = []
        for size in range(1, len(rule) + 1):
            p, n = sums(prune.where(all_of(rule[:size])))
            worth.append(((p - n) / (p + n) if p + n else -1.0, -size))
        if not worth or max(worth)[0] <= 0.8:  # a rule must be right nine times in ten
            break
        rule = tightest(rule[: -max(worth)[1]])
        found.append(rule)
        left = left.where(~all_of(rule))
    return _halfway(found, stats)


def tightest(rule: list[Condition]) -> list[Condition]:
    """The rule with one condition a feature and direction: the others follow from it."""
    out: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        key = (c.feature, c.above)
        if key not in out or (c.value > out[key].value) == c.above:
            out[key] = c
    return list(out.values())


def _halfway(rules: Rules, stats: DataFrame) -> Rules:
    """Each threshold moves to the middle of the gap between the sample's values on its two sides."""
    flat = sorted({c for rule in rules for c in rule}, key=str)
    if not flat:
        return rules
    asked = []
    for i, c in enumerate(flat):
        x = F.coalesce(F.expr(FEATURES[c.feature]).cast("double"), F.lit(0.0))
        asked += [F.max(F.when(x <= c.value, x)).alias(f"lo{i}"), F.min(F.when(x > c.value, x)).alias(f"hi{i}")]
    got = stats.agg(*asked).first()
    moved = {}
    for i, c in enumerate(flat):
        lo, hi = got[f"lo{i}"], got[f"hi{i}"]
        moved[c] = c if lo is None or hi is None else Condition(c.feature, c.above, (lo + hi) / 2)
    return [[moved[c] for c in rule] for rule in rules]


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """The statistics and verdict of each row."""
    s = statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return s.select(
        "doc_id", *[F.col(f"stat_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", (~F.col("base_failed") & expression(rules)).alias("kept"),
    )
