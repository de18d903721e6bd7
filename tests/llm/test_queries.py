"""The registered queries: columns, types, row counts, and oracles on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")

COLUMNS = {
    "op1": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3": "page_id bigint, url string, text string, n_chars bigint",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7": "page_id bigint, host string, path string, rule string, verdict string",
    "op8": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op13": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}
NAMES = sorted((n for n in entry.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))


def test_all_queries_and_the_pipeline():
    assert [n.split("_")[0] for n in NAMES] == list(COLUMNS) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_contract(name, spark):
    df = entry.queries()[name](spark, str(SF))
    want = dict(c.split(" ") for c in COLUMNS[name.split("_")[0]].split(", "))
    assert want.items() <= dict(df.dtypes).items()
    table, each = ("pages", 1) if "page_id" in want else ("embeddings", 8) if "vec_id" in want else ("documents", 1)
    if name.startswith("op13"):
        return
    assert df.count() == each * spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_oracle(name, spark):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, str(SF))
    cur = c.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    want = [tuple(r[cur.columns.index(k)] for k in names) for r in cur.fetchall()]
    norm = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert norm(tuple(r[k] for k in names) for r in df.collect()) == norm(want)
