"""Improbable-feature digests: rare byte windows in chained Bloom filters.

1. Every window of W = 8 bytes gets its Shannon entropy; all windows of a buffer are found together, by counting
   for each byte its equals among the bytes of the window before and after and summing what a step of the window changes.
2. Rarity is measured: entropies of the windows of all texts are counted, and the rank of a window is the share of
   windows with its entropy, rarest first. Windows under ``WEAK`` bits come last, whatever their share.
3. In every run of 64 neighbouring windows (runs reach beyond both ends, so that all windows are in as many) the
   leftmost of least rank is counted; windows counted 16 times or more are the features. The rule is the same for texts of all lengths.
4. The features' hashes fill Bloom filters of 2048 bits, 5 bits a feature, 160 features a filter; a full filter
   is followed by the next.
5. Likeness: each filter of the digest with fewer filters takes its best partner in the other; the bits that both share,
   less what chance gives, over the most they could share; the mean weighs filters by features.

Fingerprints compare where their rarity was measured alike: ``measure`` gives the table once, and ``fingerprints`` takes it.
Every row is measured, as often as it stands, and fingerprinted; what is gathered of the measure is a number a place of entropy.

Defined cases: empty or null text: an empty fingerprint, like another empty one (1.0) and unlike any other (0.0);
a text under 8 bytes is one window, filled up with zeros; of a text whose windows are all weak, weak ones are features.
Documents follow each other by (doc_id, text), nulls last; the last is followed by the first; a
single document follows itself. Repeated rows follow each other. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy

W, POPULAR, LEAST, BITS, PER_FILTER, HASHES = 8, 64, 16, 2048, 160, 5
WEAK = 2.0
STEPS = 64  # to a bit of entropy
LAST = 1 << 24  # the rank of weak windows
_UNIT = 1 << 24
_F = np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, W + 1)], np.int64)
_GROW = np.append(_F[1:] - _F[:-1], 0)  # from c to c + 1
_MUL = np.uint64(0x9E3779B97F4A7C15)
_END = np.full(POPULAR - 1, np.iinfo(np.int64).max)


def entropies(buf: np.ndarray) -> np.ndarray:
    """The entropy of the window at each byte of the buffer, in steps of 1 / STEPS bit."""
    n = len(buf) - W + 1
    before, after = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for d in range(1, W):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = int(_F[np.bincount(buf[:W], minlength=256)].sum())
    step = _GROW[before[W:]] - _GROW[after[: n - 1]]
    total = np.concatenate(([first], first + np.cumsum(step)))
    return np.rint(STEPS * (np.log2(W) - total / (W * _UNIT))).astype(np.int64)


def rarity_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy, from how many windows had it; without any, far from the middle is rare."""
    counts = np.asarray(counts, np.float64)
    if counts.sum() == 0:
        counts = 1 / (1 + np.abs(np.arange(len(counts)) - len(counts) * 0.9))
    rank = np.rint(1_000_000 * counts / counts.sum()).astype(np.int64)
    rank[: int(WEAK * STEPS)] = LAST
    return rank


PLACES = int(np.log2(W) * STEPS) + 1


def _padded(text: bytes) -> bytes:
    return text.ljust(W, b"\0") if text else b""


def _hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at the given places."""
    words = np.lib.stride_tricks.sliding_window_view(buf, W)[at].copy().view(np.uint64)
    h = np.full(len(at), np.uint64(W))
    with np.errstate(over="ignore"):
        for j in range(W // 8):
            h = (h ^ words[:, j]) * _MUL
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


def features(texts: list[bytes], rarity: np.ndarray) -> list[np.ndarray]:
    """Feature hashes of each text, in order of place and without repeats."""
    out = [np.empty(0, np.uint64)] * len(texts)
    texts = [_padded(t) for t in texts]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf):
        return out
    rank = rarity[entropies(buf)]
    start = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        n = len(t) - W + 1
        r = rank[start : start + n]
        low, span = np.concatenate((_END, (r << 32) | np.arange(n), _END)), 1
        while span < POPULAR:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        often = np.bincount(low & 0xFFFFFFFF, minlength=n) >= LEAST
        places = np.flatnonzero(often & (r < LAST))
        if not len(places):
            places = np.flatnonzero(often)
        h = _hashes(buf[start : start + n + W - 1], places)
        out[i] = h[np.sort(np.unique(h, return_index=True)[1])]
        start += len(t)
    return out


def measure(docs: DataFrame, rows: int = 0, most: int | None = None) -> np.ndarray:
    """The rarity of entropies over all documents, or, where the caller gives ``most``, over about so many of the ``rows``.

    Such a share is told by 64 bits of a hash, whatever the number of rows; where no text of it has a window, it is widened until
    one has or all rows are read.
    """
    share = 1.0 if most is None else min(1.0, most / max(1, rows))
    counts = _entropy_counts(docs, share)
    while not counts.sum() and share < 1:
        share = min(1.0, 64 * share)
        counts = _entropy_counts(docs, share)
    return rarity_of(counts)


def _window_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy; texts lie one behind the other, windows across two of them are taken off."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf):
        return np.zeros(PLACES, np.int64)
    got = entropies(buf)
    ends = np.cumsum([len(t) for t in texts if t])[:-1]
    across = (ends[:, None] - np.arange(1, W)).ravel()
    return np.bincount(got, minlength=PLACES) - np.bincount(got[across], minlength=PLACES)


def _entropy_counts(docs: DataFrame, share: float, budget: int = 1_000_000) -> np.ndarray:
    """How many windows have each entropy, over a share of the documents; a task sends one row a place."""
    texts = docs.where("text is not null")
    if share < 1:
        texts = texts.where(F.xxhash64(F.lit(7), "doc_id", "text") < F.lit(int(share * 2**64) - 2**63))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part, size = np.zeros(PLACES, np.int64), [], 0
        for pdf in batches:
            for t in pdf["text"]:
                part.append(_padded(t.encode("utf-8", "surrogatepass")))
                size += len(part[-1])
                if size > budget:
                    total += _window_counts(part)
                    part, size = [], 0
        total += _window_counts(part)
        yield pd.DataFrame({"place": np.arange(PLACES), "n": total})

    got = texts.select("text").mapInPandas(tidy(count), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # PLACES rows
    counts = np.zeros(PLACES)
    counts[got["place"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return counts


class Digest:
    """Filters as rows of bits, with the number of features in each."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.count = np.array([min(PER_FILTER, n - i) for i in range(0, n, PER_FILTER)], np.int64)
        self.bits = np.zeros((len(self.count), BITS), np.uint8)
        which = np.arange(n) // PER_FILTER
        for j in range(HASHES):
            self.bits[which, ((hashes >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = 1

    def text(self) -> str:
        if not len(self.count):
            return ""
        return f"{len(self.count)}.{int(self.count[-1])}." + np.packbits(self.bits, axis=1).tobytes().hex()

    def like(self, other: Digest) -> float:
        a, b = (self, other) if len(self.count) <= len(other.count) else (other, self)
        if not len(a.count) or not len(b.count):
            return 1.0 if len(a.count) == len(b.count) else 0.0
        y, total = b.bits.astype(np.float32), 0.0
        ny = y.sum(1)[None, :]
        for i in range(0, len(a.count), 256):
            x = a.bits[i : i + 256].astype(np.float32)
            both, nx = x @ y.T, x.sum(1)[:, None]
            chance, most = nx * ny / BITS, np.minimum(nx, ny)
            score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0).max(1)
            total += float((score * a.count[i : i + 256]).sum())
        return total / float(a.count.sum())


def _next_edit(text: str, after: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut] if cut else text


def _digester(rarity: np.ndarray, budget: int = 1_000_000):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def digests(texts: list[str]) -> list[Digest]:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t.encode("utf-8", "surrogatepass"))
            size += len(part[-1])
            if size > budget:
                out += [Digest(h) for h in features(part, rarity)]
                part, size = [], 0
        return out + [Digest(h) for h in features(part, rarity)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (bucket, ahead, doc_id, text, digest) of the row before
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            rows = list(zip(pdf["bucket"], pdf["ahead"], pdf["doc_id"], texts, digests(texts)))
            line = ([held] if held else []) + rows
            held = line[-1] if line else None
            pairs = [(a, b) for a, b in zip(line, line[1:]) if a[0] == b[0] and not a[1]]
            edits = [_next_edit(a[3], b[3]) for a, b in pairs]
            out = []
            for (a, b), e, d in zip(pairs, edits, digests(edits)):
                sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((a[2], len(a[3]), sha, a[4].text(), d.text(), a[4].like(d), a[4].like(b[4])))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return run


def _bucket(of: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= the value, by two short scans."""
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= of))
    if not groups:
        return F.lit(0)
    coarse = below(array([g[0] for g in groups]))
    fine = below(F.element_at(F.array(*[array(g) for g in groups]), F.greatest(coarse, F.lit(1))))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * wide + fine)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, rows: int = 800, most: int = 16_384, rarity: np.ndarray | None = None) -> DataFrame:
    """The digest of each row's text and of its edit with the row that follows; ``rarity`` is measured unless given.

    Rows are dealt by ranges of doc_id, of about ``rows`` each and ``most`` ranges at most; the texts move once. The
    first row of a range is also sent to the range before it, so that every row meets its follower.
    """
    d = docs.select("doc_id", "text")
    count = d.count()
    rarity = measure(d) if rarity is None else rarity
    parts = max(1, min(most, count // rows))
    bounds = d.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("b")).first()["b"] if parts > 1 else []
    bucket = F.coalesce(_bucket(F.col("doc_id"), sorted(set(bounds or []))), F.lit(most + 1)).cast("int")
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), most + 1).otherwise(bucket).cast("int"))
    # One row a range: the smallest id in it; ranges are at most ``most`` + 2.
    heads = {r["bucket"]: r["head"] for r in d.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect()}
    if not heads:
        return d.sparkSession.createDataFrame([], SCHEMA)
    order = sorted(heads)
    # The range before each head's; rows without an id are the last range, and its head is null.
    ahead = [(heads[b], order[i - 1]) for i, b in enumerate(order)]
    named = d.sparkSession.createDataFrame([x for x in ahead if x[0] is not None], "head long, extra int")
    d = d.join(F.broadcast(named), F.col("doc_id") == F.col("head"), "left").drop("head")
    extra = F.when(F.col("doc_id").isNull(), dict(ahead).get(None)).otherwise(F.col("extra"))
    rows_ = d.withColumn("to", F.explode(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")), F.when(extra.isNotNull(), F.struct(extra.alias("bucket"), F.lit(1).alias("ahead"))))))
    rows_ = rows_.where("to is not null").select("to.bucket", "to.ahead", "doc_id", "text")
    dealt = rows_.repartition(len(order), "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    return dealt.mapInPandas(tidy(_digester(rarity)), SCHEMA)
