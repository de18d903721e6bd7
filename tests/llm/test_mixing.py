import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing

from .conftest import DOCS, words


def weights_by_hand(sizes, share=1.5, cap=2.0):
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= cap * sizes[s] - 1e-12:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def check(docs):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        assert r["mix_size"] == len(words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix_size"]
    targets = weights_by_hand(sizes)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert all(r["mix_source_size"] == sizes[s] for r in mine)
        assert all(abs(r["mix_target"] - targets[s]) < 1e-5 for r in mine)
        assert all(0 <= r["mix_copies"] <= 2 for r in mine)
        taken = sum(r["mix_copies"] * r["mix_size"] for r in mine)
        assert abs(taken - targets[s]) <= max(r["mix_size"] for r in mine) / 2 + 1e-6
    return rows


def test_targets_and_nearness(corpus):
    rows = check(corpus)
    again = mixing.mix(corpus.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["mix_copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_awkward(awkward_docs):
    check(awkward_docs)


def test_empty(empty_docs):
    assert mixing.mix(empty_docs).count() == 0


def test_clashing_columns(corpus):
    d = corpus.withColumn("mix_size", F.lit("x")).withColumn("extra", F.lit(1))
    out = mixing.mix(d)
    assert "extra" in out.columns and dict(out.dtypes)["mix_size"] == "bigint"
    assert out.count() == 120


def test_unequal_importance(corpus):
    """Inclusion follows the importance column, and sources still meet their targets."""
    d = corpus.where("source = 'hot'")
    rows = mixing.mix(d, importance=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0), share=0.5).collect()
    share = lambda odd: sum(r["mix_copies"] * r["mix_size"] for r in rows if r["doc_id"] % 2 == odd) / sum(r["mix_size"] for r in rows if r["doc_id"] % 2 == odd)
    assert share(0) > 1.5 * share(1)


def test_repeated_rows(corpus):
    mixed = mixing.mix(corpus)
    n = mixed.agg(F.sum("mix_copies")).first()[0]
    assert mixing.repeated(mixed, corpus.columns).count() == n


@pytest.fixture(scope="module")
def tied(spark):
    """Sources of many equal rows, of which only a part fits; rows without an id, of one text and of several."""
    ten = "a b c d e f g h i j"
    rows = [(5, ten, "en", "rep", 19)] * 300 + [(6, ten, "en", "other", 19)] * 40 + [(None, ten, "en", "none", 19)] * 70
    rows += [(None, f"{i} b c d e f g h i j", "en", "none2", 19) for i in range(50)] + [(i, ten + " k" * (i % 3), "en", "plain", 19) for i in range(100, 160)]
    return spark.createDataFrame(rows, DOCS).repartition(7)


def test_a_line_between_equal_rows(tied):
    rows = check(tied)
    again = mixing.mix(tied.repartition(3)).collect()
    key = lambda r: (r["source"], r["doc_id"] or -1, r["mix_size"], r["mix_copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    copies = {r["mix_copies"] for r in rows if r["source"] == "rep"}
    assert len(copies) == 2  # the line does fall between equal rows


@pytest.mark.parametrize("which", ["corpus", "awkward_docs", "tied"])
def test_oracle(which, request):
    docs = request.getfixturevalue(which)
    c = duckdb.connect()
    c.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(repr, ((r[0], *r[1:3], round(r[3], 6), r[4]) for r in c.sql(mixing.ORACLE).fetchall())))
    got = mixing.mix(docs).select("doc_id", "mix_size", "mix_source_size", "mix_target", F.col("mix_copies") * F.col("mix_size")).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
