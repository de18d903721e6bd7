import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import bpe


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers as P

    mine = bpe.load_bpe(*bpe.tokenizer_file("byte_bpe_50k.tiktoken"))
    return mine, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_any_text(pair, text):
    mine, want = pair
    text = text.encode("utf-8", "ignore").decode()
    ids = mine.encode(text)
    assert ids == want.encode_ordinary(text) and mine.decode(ids).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abe thin\xe9\u65e5", min_size=1, max_size=200), st.integers(0, 200))
def test_join_is_the_encoding(pair, text, at):
    """The monoid's law: however a run of bytes is cut, joining the halves' ids gives the ids of the whole."""
    mine, _ = pair
    data = text.encode()
    at = min(at, len(data))
    whole = mine._flat(data)
    assert mine.join(mine._flat(data[:at]), mine._flat(data[at:])) == whole == mine.piece(data)


@pytest.mark.parametrize("piece", ["a" * 9000, "ab" * 4000, " " * 3000, "é" * 4000, "the" * 3000, "-=" * 2000, "日本" * 1500, "abcdefghij" * 900])
def test_long_pieces(pair, piece):
    mine, want = pair
    assert mine.piece(piece.encode()) == list(want._encode_single_piece(piece.encode()))


def test_small_and_large_merging_agree(pair):
    mine, want = pair
    for n in (1, 2, 31, 63, 64, 65, 66, 200):
        data = (b"internationalisation " * 20)[:n]
        assert mine._flat(data) == list(want._encode_single_piece(data))


def test_rows(pair, awkward_docs, empty_docs):
    _, want = pair
    rows = bpe.encode_documents(awkward_docs.withColumn("ids", F.lit(1)), with_ids=True).collect()
    texts = awkward_docs.collect()
    expect = []
    for r in texts:
        ids = want.encode_ordinary(r["text"] or "")
        expect.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(repr, expect)) == sorted(repr(tuple(r)[:4]) for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert bpe.encode_documents(empty_docs).count() == 0
