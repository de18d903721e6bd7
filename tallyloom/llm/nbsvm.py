"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, word pairs, and runs of one to three word shapes (a shape
keeps case pattern, digits and punctuation of a word and whether it repeats the word before). They are
hashed to ``2**BITS`` places. Training scales each indicator by the log ratio of its smoothed document
counts in the two classes and fits a linear model with hinge loss by dual coordinate descent
(L2 penalty, box 0..C, one dual variable a document, random order per epoch); the weights are averaged with
their mean magnitude as in the published interpolation. A sigmoid fitted on the training documents
turns margins into scores.

Bound: at most ``most`` labelled documents (in order of a hash of the id, held-out fold excluded) train
the model; features of each are at most 2**BITS numbers. Everything else covers all documents whole.

Defined cases: null and empty text have no n-gram and get the score of the bias alone; without
labels of both classes every score is the share of label 1 (or 0.5 without any); rows are scored one by
one, so repeated rows and null ids keep their place; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import fold, labelled_sample, sigmoid_fit, tidy

BITS = 18
_MASK = np.uint64((1 << BITS) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def shape(word: str) -> str:
    """Letters become X (upper), x (lower) or Xx by run, digits 9; other characters stay, three of a kind at most."""
    s = _LETTERS.sub(lambda m: "x" if m[0].islower() else "X" if m[0].isupper() and len(m[0]) > 1 else "Xx", word)
    s = _DIGITS.sub("9", s)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", s)


class _Words(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        w = word.decode("utf-8", "replace")
        self[word] = v = (xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape(w).encode(), 7))
        return v


def features(text: str | None, known: _Words) -> np.ndarray:
    """Sorted distinct feature places of a whole text."""
    words = text.encode("utf-8", "replace").split() if text else []
    if not words:
        return np.empty(0, np.int64)
    pairs = np.array([known[w] for w in words], np.uint64)
    w, s = pairs[:, 0], pairs[:, 1].copy()
    s[1:] ^= np.where(w[1:] == w[:-1], _C, np.uint64(0))
    with np.errstate(over="ignore"):
        grams = [w * _A, s * _B + np.uint64(1)]
        if len(w) > 1:
            grams += [(w[:-1] * _A ^ w[1:]) * _C + np.uint64(2), (s[:-1] * _B ^ s[1:]) * _A + np.uint64(3)]
        if len(w) > 2:
            grams += [((s[:-2] * _B ^ s[1:-1]) * _A ^ s[2:]) * _C + np.uint64(4)]
        g = np.concatenate(grams)
        g ^= g >> np.uint64(31)
        g *= _B
        return np.unique((g >> np.uint64(64 - BITS)) & _MASK).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, idx: np.ndarray) -> float:
        return float(self.weights[idx].sum() / np.sqrt(max(len(idx), 1))) + self.bias


def dual_coordinate_descent(rows: list[np.ndarray], weigh: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Linear support vectors with hinge loss; the bias is one more feature of value 1.

    A row is the places of its features; their values are ``weigh`` there, scaled by the row's own size. They are made
    anew at each visit, so only the places are held.
    """
    w, bias, alpha = np.zeros(len(weigh)), 0.0, np.zeros(len(y))
    scale = np.array([1 / np.sqrt(max(len(r), 1)) for r in rows])
    norm = np.array([float((weigh[r] ** 2).sum()) * k * k + 1.0 for r, k in zip(rows, scale)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            at = rows[i]
            v = weigh[at] * scale[i]
            g = y[i] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), c[i])
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[at] += d * v
                bias += d
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 8, least: int = 3, beta: float = 0.75, seed: int = 5) -> Model:
    """``y``: 1 or 0. Features in fewer than ``least`` documents weigh nothing."""
    dim = 1 << BITS
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        return Model(np.zeros(dim), 0.0, 0.0, float(np.log(p / (1 - p))))
    pos, neg = np.ones(dim), np.ones(dim)
    for r, label in zip(rows, y):
        (pos if label else neg)[r] += 1
    ratio = np.log(pos / (y.sum() + 2)) - np.log(neg / ((1 - y).sum() + 2))
    ratio[pos + neg - 2 < least] = 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, c * len(y) / (2 * y.sum()), c * len(y) / (2 * (1 - y).sum()))  # both classes weigh the same
    w, bias = dual_coordinate_descent(rows, ratio, sign, cost, epochs, seed)
    used = np.abs(w) > 1e-12  # what rounding leaves of weights that went back to zero is none
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    model = Model(((1 - beta) * mean + beta * w) * ratio, bias, 1.0, 0.0)
    margins = np.array([model.margin(r) for r in rows])
    model.a, model.b = sigmoid_fit(margins, y)
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held: int = 0, most: int = 8_000) -> Model:
    sample = labelled_sample(docs, labels, target, folds, held, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "f": [features(t, known).astype(np.int32) for t in pdf["text"]]})

    got = sample.mapInPandas(tidy(run), "doc_id long, y int, f array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return fit([], np.empty(0))
    lists = got.column("f").combine_chunks()
    ends, places = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    return fit([places[ends[i] : ends[i + 1]] for i in order], got.column("y").to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5, held: int = 0, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted per row; with ``keep`` all columns of ``docs`` of the rows predicted 1."""
    weights = model.weights.astype(np.float32)
    small = Model(weights, model.bias, model.a, model.b)

    def scored(texts, known) -> list[float]:
        m = np.array([small.margin(features(t, known)) for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(small.a * m + small.b, -30, 30)))

    if keep:

        def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pyarrow as pa

            known = _Words()
            for batch in batches:
                yield batch.filter(pa.array(scored(batch.column("text").to_pylist(), known) >= threshold, pa.bool_()))

        return docs.mapInArrow(tidy(filtered), docs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for pdf in batches:
            s = scored(pdf["text"], known)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    out = docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
