"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

1. Lexicon. Over a bounded sample of labelled documents (held-out fold excluded) the words' document
   counts by class are aggregated in Spark; words far likelier in toxic documents become terms, and word
   beginnings that many such words share become stems (inflected forms then match though never seen).
2. Matching. Terms and stems form a trie. A word of a text is matched by walking the trie and the word's
   Levenshtein automaton together: a state is the set of (position, edits) the automaton can be in, kept
   as one bit vector per number of edits, and a branch is cut once no state is alive. An edit inserts, drops or replaces a
   letter or swaps two neighbours; terms of ``FUZZY`` letters take one, of ``LONG`` letters two. Shorter terms and stems match exactly only.
3. Context. Each hit has a window of ``WINDOW`` words on both sides. A pair of quotation marks around it and
   words of reporting lower its weight, address and a further hit raise it. Marks are paired by direction (“…”, „…“, «…», »…«, ‘…’) or,
   where they have none, by turns; an apostrophe between letters is a letter, and no pair crosses a line. The features of a document
   (exact, misspelled, stem hits, quoted and unquoted, per length) go to a logistic model
   fitted on the sample; no weight is negative, so a hit never speaks for a document.

Bound: ``most`` labelled documents; all their words may become terms. A term is in four toxic documents of the sample at
least, between six different pairs of neighbours; rarer ones can't be told from chance.

Defined cases: null and empty text have no hit and score the model's bias; a table without labels of both
classes gives the share of label 1 (0.5 without any); rows are scored one by one, so repeated rows
and null ids keep their place; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import fold, labelled_sample, materialize, tidy

FUZZY, LONG, WINDOW = 5, 9, 8
TOKEN = re.compile(r"[^\W_]+|(?<![^\W\d_])[’‘]|[’‘](?![^\W\d_])|[\"“”„«»‚\n]")
#: What ends a quotation that a mark begins. A mark that ends an open one begins none.
CLOSED_BY = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", '"': '"'}
MARKS = frozenset("\"“”„«»‘’‚\n")
REPORTING = frozenset("said says wrote quoted called quote reported claimed alleged dit écrit cité sagte schrieb zitiert dijo escribió citado".split())
ADDRESS = frozenset("you your youre tu te toi vous du dich dir ihr tú usted eres".split())


@dataclass
class Trie:
    """A trie over terms; ``end`` is the term's index where one ends, ``stem`` whether any ending may follow."""

    next: dict[str, Trie] = field(default_factory=dict)
    end: int = -1
    stem: bool = False

    @staticmethod
    def of(terms: list[str], stems: list[str]) -> Trie:
        root = Trie()
        for i, (word, stem) in enumerate([(t, False) for t in terms] + [(s, True) for s in stems]):
            node = root
            for ch in word:
                node = node.next.setdefault(ch, Trie())
            node.end, node.stem = i, stem
        return root

    def exact(self, word: str) -> tuple[str, int] | None:
        node, stem = self, None
        for ch in word:
            node = node.next.get(ch)
            if node is None:
                return stem
            if node.stem:
                stem = ("stem", node.end)
        return ("term", node.end) if node.end >= 0 and not node.stem else stem

    def within(self, word: str, edits: int) -> tuple[int, int] | None:
        """(term, distance) of a term at the least distance up to ``edits``; stems don't count."""
        n, accept = len(word), 1 << len(word)
        full = (1 << (n + 1)) - 1
        places: dict[str, int] = {}
        for i, ch in enumerate(word):
            places[ch] = places.get(ch, 0) | 1 << i
        # state: one bit vector per number of edits; bit i: i letters of the word are read. The second vector holds
        # places where the term's last letter was the word's next but one, so that its next may complete a swap.
        start = [(1, 0)]
        for _ in range(edits):
            start.append((start[-1][0] | start[-1][0] << 1 & full, 0))
        best: tuple[int, int] | None = None
        todo = [(self, start)]
        while todo:
            node, state = todo.pop()
            if node.end >= 0 and not node.stem:
                for e, (bits, _) in enumerate(state):
                    if bits & accept and (best is None or (e, node.end) < (best[1], best[0])):
                        best = (node.end, e)
                        break
            for ch, child in node.next.items():
                at, new = places.get(ch, 0), []
                for e, (bits, half) in enumerate(state):
                    to, swap = (bits & at) << 1 | (half & at) << 2, 0
                    if e:
                        prev = state[e - 1][0]
                        to |= prev | prev << 1 | new[e - 1][0] << 1  # insert, replace, delete
                        swap = prev & at >> 1
                    new.append((to & full, swap))
                if any(bits or half for bits, half in new):
                    todo.append((child, new))
        return best


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray


class Matcher(dict):
    """word -> hit kind (0 none, 1 exact, 2 stem, 3 misspelled), cached.

    The automaton walks a trie of only the terms that the word can be near to: an edit (a swap, too) leaves the first two or the last
    two letters of a term as they are, two edits those or the letters from the fourth to the sixth, moved by one place at most;
    the lengths differ by the edits at most, and each edit takes one of the term's letters away at most.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        super().__init__()
        self.terms, self.trie = terms, Trie.of(terms, stems)
        self.edits = [0 if len(t) < FUZZY else 1 if len(t) < LONG else 2 for t in terms]
        self.letters = [frozenset(t) for t in terms]
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        self.middles: dict[str, set[int]] = {}
        for i, t in enumerate(terms):
            if self.edits[i]:
                self.heads.setdefault(t[:2], set()).add(i)
                self.tails.setdefault(t[-2:], set()).add(i)
            if self.edits[i] == 2:
                self.middles.setdefault(t[3:6], set()).add(i)
        self.few: dict[tuple[int, ...], Trie] = {}

    def misspelled(self, word: str) -> bool:
        none: set[int] = set()
        some = self.heads.get(word[:2], none) | self.tails.get(word[-2:], none)
        for at in (2, 3, 4):
            some = some | self.middles.get(word[at : at + 3], none)
        if not some:
            return False
        letters, n = set(word), len(word)
        for edits in (1, 2):
            near = tuple(sorted(i for i in some if self.edits[i] == edits and abs(len(self.terms[i]) - n) <= edits and len(self.letters[i] - letters) <= edits))
            if not near:
                continue
            if near not in self.few:
                if len(self.few) > 10_000:
                    self.few.clear()
                self.few[near] = Trie.of([self.terms[i] for i in near], [])
            if self.few[near].within(word, edits) is not None:
                return True
        return False

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        low = word.lower()
        if (hit := self.trie.exact(low)) is not None:
            kind = 1 if hit[0] == "term" else 2
        else:
            kind = 3 * self.misspelled(low)
        self[word] = kind
        return kind


N_FEATURES = 9


def quoted_words(tokens: list[str]) -> list[bool]:
    """Whether each word is inside a pair of quotation marks; the marks in ``tokens`` go."""
    depth: list[int] = [0]  # by how much the number of open pairs changes at each word
    open_: list[tuple[str, int]] = []
    for t in tokens:
        if t not in MARKS:
            depth.append(0)
            continue
        at = len(depth) - 1
        if t == "\n":
            open_.clear()
            continue
        match = next((k for k in range(len(open_) - 1, -1, -1) if t in CLOSED_BY[open_[k][0]]), -1)
        if match >= 0:
            depth[open_[match][1]] += 1
            depth[at] -= 1
            del open_[match:]
        elif t in CLOSED_BY:
            open_.append((t, at))
    out, now = [], 0
    for d in depth[:-1]:
        now += d
        out.append(now > 0)
    return out


def features(text: str | None, matcher: Matcher) -> np.ndarray:
    """Counts over the whole text: exact, stem, misspelled hits; unquoted of each; best window; share of hits; any."""
    out = np.zeros(N_FEATURES)
    tokens = TOKEN.findall(text) if text else []
    words = [w for w in tokens if w not in MARKS]
    kinds = list(map(matcher.__getitem__, words))
    if not any(kinds):
        return out
    hits = [i for i, k in enumerate(kinds) if k]
    inside = quoted_words(tokens)
    for i in hits:
        near = [w.lower() for w in words[max(0, i - WINDOW) : i + 1 + WINDOW]]
        quoted = inside[i]
        told = any(w in REPORTING for w in near)
        spoken = any(w in ADDRESS for w in near)
        others = sum(1 for k in kinds[max(0, i - WINDOW) : i + 1 + WINDOW] if k) - 1
        weight = (0.4 if quoted else 1.0) * (0.7 if told and quoted else 1.0) * (1.2 if spoken else 1.0) * (1 + 0.5 * min(others, 2))
        if kinds[i] == 3:
            weight *= 0.5
        out[kinds[i] - 1] += 1
        out[2 + kinds[i]] += not quoted
        out[6] = max(out[6], weight)
    out[:6] = np.log1p(out[:6])
    out[7] = np.log1p(100 * len(hits) / len(words))
    out[8] = float(any(k in (1, 2) for k in kinds))
    return out


def lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and word beginnings of toxic documents, by smoothed log odds of their document counts.

    A word must also be met between different neighbours: the words of a passage that is copied through many
    toxic documents always have the same ones, and say nothing.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    sample = sample.select("y", tokens.alias("t"))
    words = sample.select("y", F.explode(F.array_distinct("t")).alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    met = F.transform("t", lambda w, i: F.struct(w.alias("w"), F.xxhash64(F.get("t", i - 1), F.get("t", i + 1)).alias("c")))
    met = sample.where("y = 1").select(F.explode(met).alias("m")).groupBy(F.col("m.w").alias("w")).agg(F.countDistinct("m.c").alias("places"))
    words = materialize(words.join(met, "w", "left").where("length(w) > 2").fillna({"places": 0}), "toxic-words")
    total = sample.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    base = float(np.log((total["p"] + 1) / (total["n"] - total["p"] + 1)))
    odds = F.log((F.col("p") + 0.1) / (F.col("n") + 0.1)) - F.lit(base)
    t = words.withColumn("odds", odds).where("p >= 4 and places >= 6 and odds > 4").orderBy(F.desc("p"), "w")
    chosen = [r["w"] for r in t.select("w").collect()]
    cuts = F.transform(F.sequence(F.lit(4), F.least(F.length("w") - 1, F.lit(7))), lambda k: F.substring("w", F.lit(1), k))
    heads = words.where("length(w) > 4").select("p", "n", "places", F.explode(cuts).alias("s"))
    heads = heads.groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("places").alias("places"), F.count_if(F.col("p") > 0).alias("forms"))
    heads = heads.withColumn("odds", odds).where("forms >= 5 and places >= 30 and odds > 4").orderBy(F.desc("p"), "s")
    found: list[str] = []
    for s in sorted((r["s"] for r in heads.select("s").collect()), key=len):
        if not any(s.startswith(f) for f in found) and not any(c.startswith(s) and len(c) - len(s) < 2 for c in chosen):
            found.append(s)
    return chosen, found


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression by Newton's method on standardised features, with weights of at least 0.

    Features whose weight comes out negative leave one after another, the most negative first, until none is.
    """
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    left = list(range(x.shape[1]))
    while True:
        z = np.hstack([((x - mean) / scale)[:, left], np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), penalty * len(y) / 10)
        ridge[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if not left or w[:-1].min() >= 0:
            break
        left.pop(int(w[:-1].argmin()))
    weights = np.zeros(x.shape[1])
    weights[left] = w[:-1]
    return weights, float(w[-1]), mean, scale


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 3, held: int = 1, most: int = 12_000) -> Model:
    sample = materialize(labelled_sample(docs, labels, target, folds, held, most), "toxic-sample")
    terms, stems = lexicon(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms, stems)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "f": [features(t, matcher) for t in pdf["text"]]})

    got = sample.mapInPandas(tidy(run), "doc_id long, y int, f array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(dtype=np.float64)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model([], [], np.zeros(N_FEATURES), float(np.log(p / (1 - p))), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    return Model(terms, stems, *fit(np.vstack(got["f"].to_list()), y))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, a row per row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model.terms, model.stems)
        for pdf in batches:
            x = np.array([features(t, matcher) for t in pdf["text"]]).reshape(-1, N_FEATURES)
            s = 1 / (1 + np.exp(-np.clip(((x - model.mean) / model.scale) @ model.weights + model.bias, -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    out = docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
