import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, top=2000, percent=80):
    """Brute force: all phrases of one to four words in one counter."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(4, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inner = Counter()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner[lang, p[i : i + m]] = max(inner[lang, p[i : i + m]], a)
    out = {}
    for (lang, p), a in often.items():
        if 100 * inner[lang, p] >= percent * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((score, a, " ".join(p), left, right))
    found = []
    for lang, many in out.items():
        many.sort(key=lambda c: (-c[0], -c[1], c[2].encode()))
        found += [(lang, i + 1, c[2], c[1], c[3], c[4], n[lang], c[0]) for i, c in enumerate(many[:top])]
    return sorted(found)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def corpus(seed, docs=150):
    rnd = random.Random(seed)
    words = ["the", "of", "The", "a\x00b", "a", "a\x01", "b", "São", "日本", "x\x1fy", "ÉA", "zz"] + [f"w{i}" for i in range(30)]
    fixed = ["of the a b", "zz São 日本", "new york city hall"]
    rows = []
    for _ in range(docs):
        parts = [rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(words[: rnd.choice([4, 42])]) for _ in range(rnd.randint(0, 80))]
        rows.append((rnd.choice(["en", "en", "de", None, "und", "q\nr", "q\\nr"]), "".join(p + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ",", "\r"]) for p in parts)))
    return rows + [("en", None), ("en", ""), (None, " \t\n"), ("empty", ".,;"), ("en", "spam " * 3000), ("en", "a b a b a b a b " * 50)]


@pytest.mark.parametrize("seed, least, top", [(1, 30, 2000), (2, 3, 2000), (3, 5, 7)])
def test_against_brute_force(spark, seed, least, top):
    rows = corpus(seed)
    docs = frame(spark, rows).withColumn("n", F.lit("clash")).withColumn("suffix", F.lit(1)).withColumn("words", F.lit(2.0))
    assert got(collocations.collocations(docs, least, top)) == plain(rows, least, top)


def test_hot_prefixes_change_nothing(spark, monkeypatch):
    """Prefixes of all lengths are hot, parts are dealt over many tasks, buffers are small, and all parts are rare or all are often."""
    rows = corpus(5) + [("en", "hot pair " + " ".join(f"hot pair x{i % 997}" for i in range(3000)))]
    expect = plain(rows, 10)
    docs = frame(spark, rows).repartition(5)
    plan = collocations.hot_prefixes(docs, 40, len(rows))
    assert {"en\nhot\n", "en\nhot\npair\n"} <= plan and len(plan) <= 3 * 80
    monkeypatch.setattr(spark.conf, "get", lambda k, *a, f=spark.conf.get: "40" if k == "spark.sql.shuffle.partitions" else f(k, *a))
    for often in (1, 10**9):
        monkeypatch.setattr(collocations, "OFTEN", often)
        assert got(collocations.collocations(docs, 10)) == expect
    keep = collocations.frequent(docs, 1, held=40)
    small = collocations.suffixes(docs, keep, plan, held=50)
    counts = collocations.stacked(small.repartition(7, collocations.route()).sortWithinPartitions(F.desc("suffix")), plan, 1)
    whole = {(r["lang"], r["phrase"], r["words"]): r["n"] for r in counts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).collect()}
    one = collocations.stacked(collocations.suffixes(docs).coalesce(1).sortWithinPartitions(F.desc("suffix")), frozenset(), 1)
    assert whole == {(r["lang"], r["phrase"], r["words"]): r["n"] for r in one.collect()}


def test_a_hot_word_is_split(spark):
    """A third of all suffixes begins with one word: no partition gets more than a few shares of them."""
    rows = [("en", " ".join(f"hot w{(i * 7 + j) % 997} x{(i + j) % 89}" for j in range(200))) for i in range(30)]
    docs = frame(spark, rows)
    hot = collocations.hot_prefixes(docs, 16, len(rows))
    dealt = collocations.suffixes(docs, hot=hot).repartition(16, collocations.route())
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert "en\nhot\n" in hot and max(sizes) < 4 * sum(sizes) / 16


def test_small_chunks_and_vocabularies_change_nothing(spark, monkeypatch):
    """Texts are read in chunks, blocks go on in the middle of a text, and words are numbered anew."""
    import pyarrow as pa

    rows = corpus(6, 40) + [("en", "x" * 500 + " y " + "z" * 300 + ". a b"), ("en", " ".join(f"v{i}" for i in range(300)))]
    def table():
        return iter([pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())})])

    def seen(held):
        f = Counter()
        for tag, line, upto, ids in collocations.blocks(table(), held):
            words = [ids.words[i] for i in line]
            for i in range(upto):
                for m in range(1, 5):
                    if all(words[i : i + m]):
                        f[tag, tuple(words[i : i + m])] += 1
        return f

    whole = seen(10**9)
    monkeypatch.setattr(collocations, "CHUNK", 64)
    monkeypatch.setattr(collocations, "VOCABULARY", 50)
    assert seen(10**9) == whole == seen(1) == seen(37)


def test_the_filter_holds_every_member(spark):
    rows = corpus(7)
    docs = frame(spark, rows)
    keep = collocations.frequent(docs, 20)
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            f.update((lang, *w[i : i + m]) for i in range(len(w)) for m in (1, 2) if i + m <= len(w))
    out, inside = [], []
    for (lang, *words), n in f.items():
        ids = collocations._Ids()
        import numpy as np

        line = np.array([ids[w.encode()] for w in words], np.int32)
        word, pair = collocations._hashes(collocations._tag(lang), line, ids)
        (inside if n >= 20 else out).append(bool(keep.has(pair if len(words) == 2 else word)[0]))
    assert all(inside) and inside and sum(out) < 0.2 * len(out)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the counts themselves are given."""
    big = 3 * 10**15
    counts = spark.createDataFrame(
        [("en", "", 0, 4 * big), ("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, f long"
    )
    docs = frame(spark, [])
    made = pytest.MonkeyPatch()
    made.setattr(collocations, "phrase_counts", lambda *_: counts)
    rows = got(collocations.collocations(docs))
    made.undo()
    assert rows == [("en", 1, "a b", big - 1, big + 1, big, 4 * big, 2_000_000 * (big - 1) // (2 * big + 1))]


def test_oracle_agrees_with_brute_force():
    rows = [(lang, t) for lang, t in corpus(8) if t is None or "\x00" not in t]
    c = duckdb.connect()
    c.execute("create table documents (lang varchar, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    cur = c.sql(collocations.oracle(5, 50))
    assert sorted(tuple(r[cur.columns.index(k)] for k in COLUMNS) for r in cur.fetchall()) == plain(rows, 5, 50)


def test_awkward_and_empty(spark, awkward_docs, empty_docs):
    rows = [(r["lang"], r["text"]) for r in awkward_docs.collect()]
    assert got(collocations.collocations(awkward_docs, 2)) == plain(rows, 2)
    assert got(collocations.collocations(empty_docs)) == []
