import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import digest


def check(docs, **more):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    got = digest.fingerprints(docs, **more).collect()
    assert len(got) == len(rows)
    want = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            prints[r["doc_id"]] = r["fingerprint"]
    texts = {}
    for d, t in rows:
        if d is not None:
            assert texts.setdefault(t or "", prints[d]) == prints[d]  # equal texts, equal fingerprints
    return got


def test_order_and_edits(corpus):
    got = check(corpus)
    check(corpus.repartition(5), rows=9)
    check(corpus, rows=1)  # more ranges than the small form of the lookup takes
    long = [r for r in got if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 > 0.3 > np.mean([r["near_next"] for r in long])


def test_awkward(awkward_docs, empty_docs, spark):
    check(awkward_docs)
    check(awkward_docs, rows=2)
    check(awkward_docs.where("doc_id is null"))
    check(awkward_docs.where("doc_id = 5"))
    check(awkward_docs.withColumn("bucket", F.lit(1)).withColumn("ahead", F.lit(1)))
    assert digest.fingerprints(empty_docs).count() == 0


def test_rarity_is_measured_at_any_size(corpus):
    """The share of a very large table is no longer 0, and a share that holds nothing is widened."""
    made_up = digest.rarity_of(np.zeros(digest.PLACES))
    for rows in (10**6, 3 * 10**9, 10**11, 10**15):
        assert not np.array_equal(digest.measure(corpus, rows), made_up)
    assert np.array_equal(digest.measure(corpus.where("text = ''"), 10**11), made_up)
    half = digest._entropy_counts(corpus, 0.5).sum() / digest._entropy_counts(corpus, 1.0).sum()
    assert 0.2 < half < 0.8


def test_every_text_is_measured(spark):
    """More texts than a sample would hold, of all lengths; the table that ``fingerprints`` uses is that of all windows."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("ab cdeé") for _ in range(rnd.choice([0, 1, 7, 8, 9, 40]))) for _ in range(5000)] + ["".join(map(chr, range(300))), None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").repartition(3)
    want = np.zeros(digest.PLACES)
    for t in texts + [texts[3]]:
        if t:
            want += np.bincount(digest.entropies(np.frombuffer(t.encode().ljust(digest.W, b"\0"), np.uint8)), minlength=digest.PLACES)
    assert np.array_equal(digest._entropy_counts(docs, 1.0, budget=1000), want) and np.array_equal(digest._entropy_counts(docs, 1.0), want)
    assert np.array_equal(digest.measure(docs), digest.rarity_of(want))
    of = lambda **more: sorted(map(repr, digest.fingerprints(docs, **more).collect()))
    assert of() == of(rarity=digest.rarity_of(want))


RARITY = digest.rarity_of(np.bincount(digest.entropies(np.frombuffer(b"".join(b"some word%d and other text. " % (i * i) for i in range(2000)), np.uint8)), minlength=digest.PLACES))


def bits_of(window):
    share = np.bincount(np.frombuffer(window, np.uint8)) / len(window)
    share = share[share > 0]
    return -(share * np.log2(share)).sum()


def test_entropies():
    rng = np.random.default_rng(1)
    buf = np.concatenate([rng.integers(97, 110, 300), np.full(100, 32), rng.integers(0, 256, 300)]).astype(np.uint8)
    got = digest.entropies(buf)
    for p in range(len(buf) - digest.W + 1):
        assert abs(got[p] / digest.STEPS - bits_of(buf[p : p + digest.W].tobytes())) <= 0.51 / digest.STEPS


def test_rarity_is_a_share():
    counts = np.zeros(digest.PLACES)
    counts[150], counts[170] = 30, 10
    rank = digest.rarity_of(counts)
    assert rank[150] == 750_000 and rank[170] == 250_000 and rank[180] == 0 and rank[3] == digest.LAST
    assert len(set(digest.rarity_of(np.zeros(digest.PLACES)))) > 3


def places_by_hand(text):
    """Windows that are the leftmost of least rank in 16 of the 64 runs which they are in."""
    t = text.ljust(digest.W, b"\0")
    rank = [int(RARITY[round(digest.STEPS * bits_of(t[i : i + digest.W]))]) for i in range(len(t) - digest.W + 1)]
    count = [0] * len(rank)
    for start in range(1 - digest.POPULAR, len(rank)):
        run = range(max(0, start), min(len(rank), start + digest.POPULAR))
        count[min(run, key=lambda i: (rank[i], i))] += 1
    good = [i for i, c in enumerate(count) if c >= digest.LEAST and rank[i] < digest.LAST] or [i for i, c in enumerate(count) if c >= digest.LEAST]
    return len({t[i : i + digest.W] for i in good}), [t[i : i + digest.W] for i in good]


def test_features_against_brute_force():
    rng = random.Random(4)
    texts = [b"a", b"one", b"zzzzzzzzzzzz", b"two words", b"z" * 200, *(" ".join(f"w{rng.randrange(500)}" for _ in range(n)).encode() for n in (3, 8, 13, 14, 40, 300))]
    for t, got in zip(texts, digest.features(texts, RARITY)):
        n, windows = places_by_hand(t)
        assert len(got) == n, t
        assert np.array_equal(got, digest._hashes(np.frombuffer(b"".join(dict.fromkeys(windows)), np.uint8), np.arange(n) * digest.W))


def test_likeness_against_brute_force():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 2**63, 700).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64)
    two[:250] = one[100:350]
    a, b = digest.Digest(one), digest.Digest(two)
    sets = lambda hs: [{(int(h) >> (11 * j)) & 2047 for h in hs[i : i + 160] for j in range(5)} for i in range(0, len(hs), 160)]
    x, y, total = sets(two), sets(one), 0.0
    for i, s in enumerate(x):
        best = 0.0
        for r in y:
            chance = len(s) * len(r) / 2048
            best = max(best, min(1.0, max(0.0, (len(s & r) - chance) / (min(len(s), len(r)) - chance))))
        total += best * len(two[160 * i : 160 * i + 160])
    assert abs(a.like(b) - total / len(two)) < 1e-6 and a.like(b) == b.like(a)


def test_batching_changes_nothing():
    texts = [b"", b"short", b"x" * 64, bytes(range(256)) * 3, b"the quick brown fox " * 40, b"z" * 1000]
    whole = digest.features(texts, RARITY)
    for t, h in zip(texts, whole):
        assert np.array_equal(digest.features([t], RARITY)[0], h)


def like(a, b):
    x, y = digest.features([a, b], RARITY)
    return digest.Digest(x).like(digest.Digest(y))


def test_near_copies_of_all_lengths():
    rng = random.Random(7)
    for n in (20, 40, 58, 60, 63, 64, 65, 70, 80, 130, 500):
        near, far = [], []
        for _ in range(30):
            t = " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(100)}" for _ in range(n))[:n]
            at = rng.randrange(n - 7)
            near += [like(t.encode(), (t[:at] + "QXZ" + t[at + 3 :]).encode()), like(t.encode(), (t + " end.").encode())]
            other = " ".join(f"{rng.choice('klmnp')}{rng.choice('aeiou')}{rng.randrange(100)}" for _ in range(n))[:n]
            far.append(like(t.encode(), other.encode()))
        assert np.mean(near) > 0.3 + max(0.0, np.mean(far)), n
        assert np.mean(far) < 0.15


def test_likeness():
    a = digest.Digest(digest.features([b"".join(b"word%d " % i for i in range(5000))], RARITY)[0])
    b = digest.Digest(digest.features([b"".join(b"other%d " % i for i in range(9000, 14000))], RARITY)[0])
    none = digest.Digest(np.empty(0, np.uint64))
    assert len(a.count) > 1 and a.like(a) == 1.0 and a.like(b) < 0.4
    assert none.like(none) == 1.0 and none.like(a) == 0.0 and none.text() == ""
