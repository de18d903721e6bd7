import collections
import random
import re
import time

from pyspark.sql import functions as F

from tallyloom.llm import decision_list as dl

from .conftest import DOCS, made_text, words


def by_hand(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(docs):
    s = dl.judge(docs, [])
    texts = docs.select("doc_id", "text").collect()
    got = sorted(repr(tuple(r)[:6]) for r in s.collect())
    assert got == sorted(repr((d, *by_hand(t))) for d, t in texts)
    for r in s.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])


def test_statistics(corpus):
    check(corpus)


def test_awkward(awkward_docs):
    check(awkward_docs)


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a b a b a b a", "a b c d a b c e b c e", "a b c\na b c\nx", "a b c d", "a a a"]
    check(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS))


def test_learns_thresholds(spark, empty_docs, no_labels):
    rnd = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        t = made_text(rnd, 80)
        bad = i % 4 == 0
        if bad:
            t = " ".join(w + "###" for w in t.split(" ")) if i % 8 else " ".join(w.upper() + "!!" for w in t.split(" "))
        rows.append((i, t, "en", "s", 0))
        marks.append((i, 0 if bad else 1, 0))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rules = dl.learn(docs, labels)
    assert rules and all(1 <= len(r) <= 3 for r in rules)
    kept = {r["doc_id"]: r["kept"] for r in dl.judge(docs, rules).collect()}
    assert sum(kept[i] == (i % 4 != 0) for i in range(400)) >= 396
    assert dl.judge(docs, rules)._jdf.queryExecution().toString().count("Python") == 0
    assert dl.learn(docs, no_labels) == [] and dl.learn(empty_docs, labels) == []
    assert dl.judge(empty_docs, rules).count() == 0


def test_extra_columns(corpus, labels):
    d = corpus.withColumn("stat_n_words", F.lit("x")).withColumn("y", F.lit(3))
    assert dl.judge(d, dl.learn(d, labels)).count() == 120


def test_a_filter_on_the_result_costs_no_more(spark, corpus):
    """Filters stay above the statistics: long texts are still read once."""
    rnd = random.Random(5)
    long = spark.createDataFrame([(i, made_text(rnd, 30_000), "en", "s", 0) for i in range(4)], DOCS)
    rules = [[dl.Condition("mean_word", True, 5.5), dl.Condition("upper_share", True, 0.2)], [dl.Condition("repeat_share", True, 0.9)]]
    start = time.time()
    assert dl.judge(long, rules).where("kept and not base_failed and n_words > 10").count() == 4
    assert dl.judge(corpus, rules).where("not kept").count() == sum(not r["kept"] for r in dl.judge(corpus, rules).collect())
    assert time.time() - start < 60
    plan = dl.judge(long, rules).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[^\x20\x09-\x0D]+, 0)") == 1  # the words are taken in one place, the generator
    assert not any("regexp" in line for line in plan.split("\n") if "Filter" in line or "Project" in line)


def test_rules_hold_no_condition_that_another_implies():
    c = dl.Condition
    rule = [c("mean_word", True, 5.5), c("mean_word", True, 6.3), c("n_words", False, 90), c("mean_word", False, 9), c("n_words", False, 80)]
    assert dl.tightest(rule) == [c("mean_word", True, 6.3), c("n_words", False, 80), c("mean_word", False, 9)]


def test_statistics_against_duckdb(corpus, awkward_docs):
    import duckdb

    for docs in (corpus, awkward_docs):
        c = duckdb.connect()
        c.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        word = r"[^\x20\x09-\x0D]+"
        want = c.sql(rf"""
            with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{word}') as w from documents),
            l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as l from t)
            select doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint, len(regexp_extract_all(text, '[#*$%&|<>]')),
                   len(l) - len(list_distinct(l)) from l""").fetchall()
        got = dl.judge(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines").collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_covering_against_brute_force(spark):
    """One numeric feature separates the classes: the first rule is the threshold that brute force finds."""
    rnd = random.Random(12)
    rows, marks = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, " ".join("x" * (rnd.randint(9, 11) if bad else rnd.randint(3, 6)) + str(rnd.randrange(10)) for _ in range(60)), "en", "s", 0))
        marks.append((i, 0 if bad else 1, 0))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rules = dl.learn(docs, labels)
    mean = lambda t: sum(map(len, t.split())) / len(t.split())
    low, high = max(mean(r[1]) for r in rows if r[0] % 5), min(mean(r[1]) for r in rows if r[0] % 5 == 0)
    first = rules[0]
    assert len(rules) == 1 and len(first) == 1
    assert first[0].feature in ("mean_word", "digit_share", "upper_share", "mark_share") and (first[0].feature != "mean_word" or min(low, high) - 0.2 <= first[0].value <= max(low, high) + 0.2)
    kept = {r["doc_id"]: r["kept"] for r in dl.judge(docs, rules).collect()}
    assert sum(kept[i] == (i % 5 != 0) for i in range(300)) >= 298
