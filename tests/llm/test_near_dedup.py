import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import near_dedup
from tallyloom.llm.components import connected_components
from tallyloom.llm.idfilter import may_hold
from tallyloom.llm.shingles import WordHashes, shingle_set

from .conftest import DOCS, made_text


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def by_hand(rows, k, percent):
    """All pairs, then components: doc_id -> (set size, smallest id)."""
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    low = {d: d for d, _ in sets}
    changed = True
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return {d: (len(s), low[d]) for d, s in sets}


def check(docs, k, percent, **more):
    rows = docs.select("doc_id", "text").collect()
    got = near_dedup.near_duplicates(docs, k, percent, **more).collect()
    assert len(got) == len(rows)
    want = by_hand(rows, k, percent)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["component_id"] == r["doc_id"])


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_brute_force(corpus, k, percent):
    check(corpus, k, percent)


def test_awkward(awkward_docs, empty_docs):
    check(awkward_docs, 3, 85)
    assert near_dedup.near_duplicates(empty_docs, 3, 85).count() == 0
    check(awkward_docs.withColumn("digest", F.lit(1)).withColumn("doc", F.lit(2)), 3, 85)


def test_chain_and_several_blocks(spark):
    """A chain in which only neighbours are alike, far longer than a block, and a hub with unlike copies."""
    rnd = random.Random(6)
    w = made_text(rnd, 300).split(" ")
    rows = [(i, " ".join(w[i * 6 : i * 6 + 120]), "en", "s", 0) for i in range(25)]
    hub = made_text(rnd, 100).split(" ")
    for i in range(40):
        t = list(hub)
        for _ in range(i % 5):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(t), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    for block in (400_000, 500):
        check(docs, 3, 85, block=block)


def test_shingles_ignore_case_of_ascii_only():
    k = WordHashes()
    same = lambda a, b: np.array_equal(shingle_set(a, 3, k), shingle_set(b, 3, k))
    assert same("A b\tC d", "a B\nc D") and not same("É b c", "é b c") and not same("a b c", "a c b")
    assert len(shingle_set("a\xa0b", 3, k)) == 1 and len(shingle_set(None, 3, k)) == 0


def test_components_of_paths_stars_and_noise(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3), (7, None)]
    edges += [(2000 + rnd.randrange(60), 2000 + rnd.randrange(60)) for _ in range(40)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    part = {r["node"]: r["component"] for r in got}
    assert len(part) == len(got)
    assert len({part[i] for i in range(201)}) == 1 and len({part[i] for i in range(1000, 1100)}) == 1
    low = {n: n for e in edges if None not in e for n in e}
    for _ in range(300):
        for a, b in edges:
            if a is not None and b is not None:
                low[a] = low[b] = min(low[a], low[b])
    groups = {}
    for n, c in part.items():
        groups.setdefault(c, set()).add(low[n])
    assert all(len(g) == 1 for g in groups.values()) and len({*map(min, groups.values())}) == len(groups)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_spanning_links_against_all_pairs():
    rnd = random.Random(3)
    for percent in (80, 85):
        for trial in range(30):
            template = list(range(1000, 1000 + rnd.choice([0, 5, 40])))
            sets = []
            for _ in range(rnd.randint(2, 40)):
                own = [rnd.randrange(10**6) for _ in range(rnd.randint(1, 20))]
                s = rnd.choice(sets)[:] if sets and rnd.random() < 0.5 else own + template
                for _ in range(rnd.randint(0, 3)):
                    s[rnd.randrange(len(s))] = rnd.randrange(10**6)
                sets.append(s)
            arrays = [np.unique(np.array(s, np.uint64)) for s in sets]
            ids = np.array(rnd.sample(range(1000), len(sets)))
            askers = trial % 3 == 0
            side = np.array([2 * (askers and rnd.random() < 0.4) for _ in sets])
            found = near_dedup.spanning_links(ids, arrays, side, percent)
            low = {int(i): int(i) for i in ids}

            def top(x, low=low):
                while low[x] != x:
                    x = low[x]
                return x

            for a, b in found:
                low[top(a)] = top(b)
            for i, x in enumerate(arrays):
                for j, y in enumerate(arrays[:i]):
                    both = len(np.intersect1d(x, y))
                    alike = 100 * both >= percent * (len(x) + len(y) - both)
                    if (int(ids[i]), int(ids[j])) in found or (int(ids[j]), int(ids[i])) in found:
                        assert alike
                    if alike and (not side.any() or side[i] == 2 or side[j] == 2):
                        assert top(int(ids[i])) == top(int(ids[j]))


def test_templated_cluster_of_many_blocks(spark):
    """Pages that share half of their words and link nowhere, with a few near copies among them, in blocks of a few pages."""
    rnd = random.Random(8)
    template = made_text(rnd, 60).split(" ")
    rows = []
    for i in range(90):
        own = [f"own{rnd.randrange(10**7)}" for _ in range(55)]
        rows.append([i, " ".join(template + own), "en", "s", 0])
    for i in range(90, 110):
        t = rows[rnd.randrange(90)][1].split(" ")
        t[rnd.randrange(60, len(t))] = f"new{i}"
        rows.append([i, " ".join(t), "en", "s", 0])
    docs = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    check(docs, 3, 85, block=1500)


def test_an_id_that_holds_many_rows(spark):
    rnd = random.Random(9)
    t = made_text(rnd, 80)
    rows = [(7, t, "en", "s", 0)] * 300 + [(None, t, "en", "s", 0)] * 200 + [(8, t + " end", "en", "s", 0), (3, t, "en", "s", 0)]
    check(spark.createDataFrame(rows, DOCS), 3, 85)


def test_the_filter_of_ids_loses_none(spark):
    docs = spark.range(0, 5000).select(F.col("id").alias("doc"), F.lit("t").alias("text"))
    chosen = spark.range(0, 5000, 50).select(F.col("id").alias("doc"))
    for bits, most in ((None, 400), (1 << 7, 5000)):
        got = {r["doc"] for r in docs.where(may_hold(chosen, "doc", F.col("doc"), bits)).collect()}
        assert got >= set(range(0, 5000, 50)) and len(got) <= most
