"""Every registered query against its DuckDB oracle on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tallyloom.plans import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(name, spark, duck):
    df = catalog.queries()[name](spark, str(SF))
    cur = duck.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(cur.columns)
    want = [tuple(r[cur.columns.index(c)] for c in names) for r in cur.fetchall()]
    assert norm(tuple(r[c] for c in names) for r in df.collect()) == norm(want)
    spark.catalog.clearCache()


#: No SQL makes a vocabulary's tokens: these are held against another library.
BY_TOKENS = {"t29_vocabulary_lengths", "t33_vocabulary_ids", "g7_token_gates"}


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) - BY_TOKENS == set(catalog.oracle_sql())


def test_tokens_of_a_vocabulary(spark):
    """Against a plain encoder of the same ranks."""
    import base64
    from statistics import median

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: plain.encode_ordinary(t) for i, (_, t) in texts.items() if t is not None}
    got = {r["doc_id"]: r["tokens"] for r in catalog.queries()["t29_vocabulary_lengths"](spark, str(SF)).collect()}
    assert got == {i: len(want[i]) if i in want else None for i in texts}
    ids = {r["doc_id"]: (r["ids"], r["mask"]) for r in catalog.queries()["t33_vocabulary_ids"](spark, str(SF)).collect()}
    assert all(ids[i] == (" ".join(map(str, w[:512])), min(len(w), 512)) for i, w in want.items())
    of = lambda lang: [got[i] for i, (g, _) in texts.items() if g == lang]
    ratio = median(of("en")) / median(of("fr"))
    gates = {r["gate"]: r["decision"] for r in catalog.queries()["g7_token_gates"](spark, str(SF)).collect()}
    assert gates["median_ratio"] == ("PASS" if ratio <= 1.15 else "BLOCK")
