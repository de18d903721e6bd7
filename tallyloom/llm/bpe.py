"""Byte-level BPE encoding and decoding by a tree reduction.

Encoding is a map into a monoid: the ids of a text are joined from the ids of its halves. Halves are
encoded recursively down to short leaves; a join re-encodes the bytes of a window of tokens around the
seam and widens it until the tokens next to the window are provably stable. The proof: a sequence of
tokens is the BPE encoding of its bytes exactly if every adjacent pair is the encoding of the pair's
bytes. Pairs inside either half hold by induction, those inside the window because it was just
encoded, so only the two pairs at the window's edges are left to check. Pieces (matches of the
splitting pattern) never merge with each other, so above them the join is concatenation.

Decoding concatenates the tokens' bytes up a tree.

Defined cases: null and empty text encode to no ids; any text round-trips, of any length; columns other
than doc_id and text are ignored; repeated rows and null ids are encoded row by row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.llm.common import tidy

LEAF = 16  # bytes
_NONE = 1 << 60


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.stable = lru_cache(200_000)(self._stable)

    def _stable(self, left: int, right: int) -> bool:
        return self._flat(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _flat(self, data: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until none is left; n log n by a heap over linked parts."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        if n <= 64:
            get, parts = ranks.get, [data[i : i + 1] for i in range(n)]
            near = [get(data[i : i + 2], _NONE) for i in range(n - 1)]
            while near:
                low = min(near)
                if low == _NONE:
                    break
                i = near.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del near[i]
                if i:
                    near[i - 1] = get(parts[i - 1] + parts[i], _NONE)
                if i < len(near):
                    near[i] = get(parts[i] + parts[i + 1], _NONE)
            return [ranks[p] for p in parts]
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != to:
                continue
            alive[j] = False
            end[i] = to
            if to < n:
                prev[to] = i
                if (r := ranks.get(data[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes."""
        if not left or not right:
            return left or right
        a, b = 1, 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            seam = b"".join(map(self.bytes_of.__getitem__, left[len(left) - a :] + right[:b]))
            mid = self._flat(seam)
            good_left = a == len(left) or self.stable(left[-a - 1], mid[0])
            good_right = b == len(right) or self.stable(mid[-1], right[b])
            if good_left and good_right:
                return left[: len(left) - a] + mid + right[b:]
            a, b = (a if good_left else 2 * a), (b if good_right else 2 * b)

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF:
            return self._flat(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def encode(self, text: str | None) -> list[int]:
        pieces, known = self.split(text or ""), self.known
        for p in set(pieces):
            if p not in known:
                if len(known) > 500_000:
                    known.clear()
                    for q in set(pieces):
                        known[q] = tuple(self.piece(q.encode("utf-8", "surrogatepass")))
                    break
                known[p] = tuple(self.piece(p.encode("utf-8", "surrogatepass")))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(4)
def load_bpe(path: str, pattern: str) -> TreeBpe:
    """The ranks file has a base64 token and its rank a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return TreeBpe(ranks, pattern)


def tokenizer_file(name: str) -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary; read where the tokens are made."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", with_ids: bool = False, chunk: int = 500_000) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load_bpe(*tokenizer_file(name))
        text_of = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

        def frame(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

        for pdf in batches:
            out, held = [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = bpe.encode(text)
                shown = " ".join(map(text_of.__getitem__, ids))
                row = (doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                out.append((*row, np.array(ids, np.int32)) if with_ids else row)
                held += len(ids)
                if held > chunk:  # what a task holds doesn't grow with the batch
                    yield frame(out)
                    out, held = [], 0
            yield frame(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInPandas(tidy(run), schema)
