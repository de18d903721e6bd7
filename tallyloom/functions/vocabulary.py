"""A vocabulary file asked in Python workers: once loaded a worker, piece by piece where its tokens can't cross pieces.

A byte-level vocabulary splits a text at its special strings and then by a fixed pattern; the ids of a text are those of its
pieces, one after the other, and a piece is split alike wherever it stands. So each distinct piece is asked once and kept, ``KNOWN``
of them at most. Other kinds of vocabularies are asked for whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, islice

KNOWN, LONGEST = 300_000, 100  # pieces that are kept, and their characters
#: The split of byte-level vocabularies (their files only name it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[int, int]:
    """The code point that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: b if b in plain else next(others) for b in range(256)}


class _Kept(dict):
    """What ``make`` gives for a piece; emptied when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str):
        got = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = got
        return got


class Whole:
    """Any vocabulary, asked for whole texts."""

    def __init__(self, tok):
        self.tok = tok

    def __call__(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def first(self, text: str, limit: int | None) -> list[int]:
        return self(text)[:limit]

    def count(self, text: str) -> int:
        return len(self(text))


class Pieces:
    """A byte-level vocabulary: the model is asked once for each distinct piece."""

    def __init__(self, model, special: dict[str, int]):
        import regex

        split, letters, tokenize = regex.compile(PATTERN), _letters(), model.tokenize
        self.all, self.each = split.findall, split.finditer
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        asked = lambda piece: tokenize(piece.encode("utf-8").decode("latin-1").translate(letters))
        self.ids = _Kept(lambda piece: (special[piece],) if piece in special else tuple(t.id for t in asked(piece)))
        self.sizes = _Kept(lambda piece: 1 if piece in special else len(asked(piece)))

    def _parts(self, text: str) -> list[str]:
        """The text, or its parts with special strings at the odd places."""
        return self.cut(text) if any(s in text for s in self.special) else [text]

    def _pieces(self, text: str) -> Iterable[str]:
        """One after the other, found as they are asked for."""
        for i, part in enumerate(self._parts(text)):
            yield from (part,) if i % 2 else (m.group() for m in self.each(part))

    def __call__(self, text: str) -> list[int]:
        return self.first(text, None)

    def first(self, text: str, limit: int | None) -> list[int]:
        """The first ``limit`` ids; pieces behind them are not asked."""
        return list(islice(chain.from_iterable(map(self.ids.__getitem__, self._pieces(text))), limit))

    def count(self, text: str) -> int:
        size = self.sizes.__getitem__
        return sum(1 if i % 2 else sum(map(size, self.all(part))) for i, part in enumerate(self._parts(text)))


@lru_cache(4)
def load(path: str) -> Whole | Pieces:
    """The vocabulary of a file; no special tokens are added, nothing is truncated or padded."""
    from tokenizers import Tokenizer  # where the tokens are made

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
    level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if model.get("type") == "BPE" and not model.get("dropout") and level and not spec.get("normalizer") and not odd:
        return Pieces(tok.model, {t["content"]: t["id"] for t in added})
    return Whole(tok)
