import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import token_counts


@pytest.fixture(scope="module")
def pair():
    path, pattern = token_counts.tokenizer_file("byte_bpe_50k.json")
    return token_counts.load_merger(path, pattern), Tokenizer.from_file(path)


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=120), max_size=6))
def test_any_texts(pair, texts):
    mine, library = pair
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert mine.count_texts(texts) == want(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aabeht <|endoftext|>\n'1é日", max_size=80), max_size=6))
def test_few_letters(pair, texts):
    mine, library = pair
    assert mine.count_texts(texts) == want(library, texts)


def test_every_letter_splits_alike(pair):
    """One text a block of code points: each letter stands between others, spaces and digits."""
    mine, library = pair
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    blocks = [every[i : i + 64] for i in range(0, 0x30000, 64)]
    texts = ["".join(f"a{c}b {c} 1{c}{c}  x" for c in block) for block in blocks]
    got, expect = mine.count_texts(texts), want(library, texts)
    wrong = [hex(ord(b[0])) for b, g, e in zip(blocks, got, expect) if g != e]
    assert not wrong


@pytest.mark.parametrize("text", ["a" * 9001, "ab" * 4000, " " * 3000, "é" * 4001, "the" * 3000, "日本" * 1500, "<|endoftext|>" * 40 + "<|endoftext", "0123456789" * 999])
def test_long_pieces(pair, text):
    mine, library = pair
    assert mine.count_texts([text, text[1:], ""]) == want(library, [text, text[1:], ""])


def test_rounds_merge_what_one_pair_at_a_time_merges(pair):
    """Brute force: the leftmost pair of lowest rank, one at a time."""
    mine, _ = pair
    rank = {int(p): int(r) for p, r in zip(mine.pairs, mine.order)}

    def slow(data):
        s = [int(mine.letters[b]) for b in data]
        while True:
            found = [(rank[k], i) for i in range(len(s) - 1) if (k := s[i] * mine.size + s[i + 1]) in rank]
            if not found:
                return len(s)
            r, i = min(found)
            s[i : i + 2] = [int(mine.made[r])]

    pieces = [b"", b"x", b"aaaaaaa", b" internationalisation", b"ssssssssissss", "überprüfung".encode(), b"zqzqzqzqzq" * 5, bytes(range(256))]
    assert mine.counts(pieces).tolist() == [slow(p) for p in pieces]


def test_small_bounds_change_nothing(pair, monkeypatch):
    mine, library = pair
    texts = [f"word{i} und Ähnliches, {'x' * i} <|endoftext|> again" for i in range(60)]
    expect = want(library, texts)
    monkeypatch.setattr(token_counts, "WAITING", 50)
    monkeypatch.setattr(token_counts, "KNOWN", 20)
    assert mine.count_texts(texts) == expect


def test_rows(pair, awkward_docs, empty_docs):
    _, library = pair
    docs = awkward_docs.withColumn("n_tokens", F.lit("clash")).withColumn("over_limit", F.lit(3)).withColumn("n_bytes", F.lit(None).cast("int"))
    texts = [(r["doc_id"], r["text"] or "") for r in awkward_docs.collect()]
    counts = want(library, [t for _, t in texts])
    expect = sorted(repr((i, len(t.encode()), n, n > 512)) for (i, t), n in zip(texts, counts))
    assert sorted(repr(tuple(r)) for r in token_counts.count_tokens(docs).collect()) == expect
    assert token_counts.count_tokens(empty_docs).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.load_merger(*token_counts.tokenizer_file("word_bpe_49k.json"))
