"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch lie one behind the other in one array of symbols (their bytes at first), with the rank of the
pair that begins at each symbol beside it. A round finds every sequence's lowest rank, merges all its pairs of that
rank at once (of overlapping ones, as in a run of one symbol, every other from the left), and looks up the ranks of the
new neighbours only. A sequence without a pair that merges leaves the arrays; its surviving symbols are its tokens.
A merge can't make a pair of lower rank than its own, since each symbol is made by one merge and used by later ones only;
so a round's pairs are those that merging one pair at a time, lowest rank first, would take before any other pair.

Distinct pre-tokens are merged once a batch, and counts of the commonest are kept for later batches. What a task holds is
bounded by ``WAITING`` bytes of pre-tokens, or the longest text where that is more.

Defined cases: null and empty texts have no bytes and no tokens; the strings of special tokens count as one token wherever they
stand in a text; texts of any length are counted whole; repeated rows and null ids are counted row by row; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.llm.common import tidy

WAITING, KNOWN = 4_000_000, 500_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class RankMerger:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], pattern: str, special: list[str]):
        import regex

        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.letters = np.array([vocabulary[c] for c in byte_letters()], np.int32)
        self.size = max(vocabulary.values()) + 1
        pairs = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        self.order = np.argsort(pairs).astype(np.int32)
        self.pairs = pairs[self.order]
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        out = np.fromiter(map(len, pieces), np.int64, len(pieces))
        who = np.flatnonzero(out > 1)
        size = out[who]
        if not len(who):
            return out
        sym = self.letters[np.frombuffer(b"".join(p for p in pieces if len(p) > 1), np.uint8)]
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[last] = _NONE
        while True:
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            done = low == _NONE
            if done.any():
                out[who[done]] = size[done]
                stay = np.repeat(~done, size)
                who, size, low = who[~done], size[~done], low[~done]
                sym, rank, last = sym[stay], rank[stay], last[stay]
                if not len(who):
                    return out
                start = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # Neighbouring hits overlap: those at odd places of such a run wait, and their first symbol is gone then.
            i = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, i, 0))
            hit = hit[(i - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            last[hit] |= last[hit + 1]
            size -= np.bincount(np.searchsorted(start, hit, "right") - 1, minlength=len(size))
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, rank, last = sym[stay], rank[stay], last[stay]
            at = hit - np.arange(len(hit))
            at = np.unique(np.concatenate((at, at[at > 0] - 1)))
            inner = at[~last[at]]
            rank[at] = _NONE
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])

    def count_texts(self, texts: list[str | None]) -> list[int]:
        known, out, waiting, new, held = self.known, [], [], {}, 0

        def settle() -> None:
            names = list(new)
            known.update(zip(names, self.counts([p.encode("utf-8", "surrogatepass") for p in names]).tolist()))
            out.extend(extra + sum(map(known.__getitem__, pieces)) for extra, pieces in waiting)
            new.clear()
            waiting.clear()

        for text in texts:
            if len(known) > KNOWN and not waiting:
                known.clear()
            parts = self.special.split(text or "") if self.special else [text or ""]
            pieces: list[str] = []
            for part in parts:
                pieces += self.split(part)
            for p in pieces:
                if p not in known and p not in new:
                    new[p] = None
                    held += len(p)
            waiting.append((len(parts) - 1, pieces))
            held += len(pieces)
            if held > WAITING:
                settle()
                held = 0
        settle()
        return out


@lru_cache(4)
def load_merger(path: str, pattern: str) -> RankMerger:
    """A byte-level vocabulary file with its merges in order of rank; other kinds of files are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    odd = [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges") or odd:
        raise ValueError(f"{path}: not a plain byte-level vocabulary")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return RankMerger(model["vocab"], merges, pattern, [t["content"] for t in spec["added_tokens"]])


def tokenizer_file(name: str) -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary; read where the tokens are counted."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger = load_merger(*tokenizer_file(name))
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            n = merger.count_texts(texts)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": sizes, "n_tokens": n})
            yield out.assign(over_limit=out["n_tokens"] > limit)

    return docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
