import random
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def made_text(rnd, n, vocabulary=4000):
    out = []
    while len(out) < n:
        size = rnd.randint(4, 12)
        out.append(" ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(size)).capitalize() + ".")
        if rnd.random() < 0.3:
            out[-1] += "\n"
        n -= size - 1
    return " ".join(out)


#: Awkward rows: null and empty texts, ties, repeated rows, null ids and sources, a very long text, other alphabets.
def awkward():
    long = " ".join(f"long{i}" for i in range(60_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "one two", "en", "b", 7),
        (6, "one", "en", None, 3), (7, long, "en", "a", len(long)), (8, "日本語 のテキスト です ü ß É", "ja", "ü", 18), (9, "x" * 5000, "en", "b", 5000),
        (9, "x" * 5000, "en", "b", 5000), (10, "Same text here for ties", "en", "a", 23), (11, "same TEXT here for ties", "en", "a", 23),
        (None, "no id here at all", "en", "a", 17), (None, None, "en", "a", None), (12, "🙂 emoji 🙂 and nbsp   seps", "en", "b", 25),
        (13, "a\n\nb\n\na\nb\n", "en", "b", 10), (14, "\x00\x01 control \x1f chars", "en", "b", 18),
    ]


@pytest.fixture(scope="session")
def awkward_docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(3, None, None), (None, 1, 0), (3, 0, 1), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def corpus(spark):
    """120 documents with exact and near copies and a hot source."""
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        rows.append([i, made_text(rnd, rnd.choice([3, 20, 80, 200])), "en", "hot" if i % 3 else f"s{i % 7}"])
    for i in range(60, 120):
        base = rnd.choice(rows[:60])[1].split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 5, 12])):
            base[rnd.randrange(len(base))] = f"new{rnd.randrange(10**6)}"
        rows.append([i, " ".join(base), "en", "hot" if i % 2 else "copies"])
    return spark.createDataFrame([(*r, len(r[1])) for r in rows], DOCS)
