"""Boolean trigram queries from regular expressions.

A pattern is walked through its parse tree. Stretches for which the set of possible strings is small
give a clause: one of these strings must occur, so all its trigrams must. The query is the conjunction of
the clauses; a pattern without a stretch of three characters has none and must be scanned in full.
Everything is folded to lower case, which only widens the candidates.
"""

from __future__ import annotations

import re._constants as k
import re._parser as parser

MOST = 64  # strings of a stretch


def _charset(items: list) -> set[str] | None:
    """The lower-cased characters of a class if they are few."""
    out: set[str] = set()
    for op, arg in items:
        if op is k.LITERAL:
            out.add(chr(arg).lower())
        elif op is k.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _exact(seq) -> set[str] | None:
    """All strings that a parse tree can match, if they are few."""
    have = {""}
    for op, arg in seq:
        if op is k.LITERAL:
            new: set[str] | None = {chr(arg).lower()}
        elif op is k.IN:
            new = _charset(arg)
        elif op is k.SUBPATTERN:
            new = _exact(arg[3])
        elif op is k.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            new = None if any(p is None for p in parts) else set().union(*parts)
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[1] <= 2:
            one = _exact(arg[2])
            new = None
            if one is not None:
                new, power = set(), {""}
                for i in range(arg[1] + 1):
                    if i >= arg[0]:
                        new |= power
                    power = {a + b for a in power for b in one}
        elif op is k.AT:
            new = {""}
        else:
            new = None
        if new is None:
            return None
        have = {a + b for a in have for b in new}
        if len(have) > MOST:
            return None
    return have


def _clauses(seq, run: set[str], found: list[set[str]]) -> set[str]:
    """Extend ``run`` along the tree, moving it to ``found`` whenever it can't go on; returns the open run."""
    for item in seq:
        op, arg = item
        one = _exact([item])
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a in run for b in one}
            continue
        found.append(run)
        run = {""}
        if one is not None:
            run = one
        elif op is k.SUBPATTERN:
            run = _clauses(arg[3], {""}, found)
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] > 0:
            found.append(_clauses(arg[2], {""}, found))
    return run


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of clauses; a clause is a list of alternatives, each the trigrams that must all occur."""
    found: list[set[str]] = []
    found.append(_clauses(parser.parse(pattern), {""}, found))
    query = []
    for strings in found:
        if all(len(s) >= 3 for s in strings):
            alts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            query.append(sorted((a for a in alts if not any(b < a for b in alts)), key=sorted))  # a weaker alternative covers a stronger
    return query
