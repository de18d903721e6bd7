"""MinHash near-duplicate detection with tensored banding and exact verification.

A table key combines one half-key of a left collection with one of a right collection, so
``m`` + ``m`` half-keys of ``h`` minhashes stand for ``m * m`` tables of ``2 h`` minhashes: the
number of minhashes is about the square root of what independent tables would need.

1. One Python pass makes each document's shingle count, a 128-bit digest of its set and its half-keys.
2. Equal sets collapse to the smallest doc_id (map-side minimum: thousands of copies cost one row a task).
3. Half-keys that only one set has are dropped first, so texts without a relative emit no table key.
4. Each table bucket gives edges to one centre, its member whose half-keys are most common, never
   all pairs. Components of these edges are candidate clusters: every pair that shares a bucket is in one.
5. Only candidates' texts move: a Bloom filter of their ids, of bounded size, stands before the shuffle. Clusters are cut into
   blocks of bounded size by hash; the cluster's centre joins each block. Inside a block sets meet through an index of
   their rarest shingles and full sets are intersected, skipping what is already connected.
6. Where a cluster has several blocks, documents that are still outside its main component meet those of the other
   blocks with which they share one of their rarest shingles, as alike sets must.
7. Components of the confirmed links, spread back over the copies.

Only links between confirmed full sets count. A pair at the threshold is missed by all tables with
a probability under ``1 - recall`` (5e-4); more similar pairs far more rarely.

Defined cases: null or empty text, or one without words: no shingles, its own component. Equal texts
are linked. Rows repeated with the same doc_id are one document (with the set of the larger digest, and
the links of any, when their texts differ); a null doc_id is returned with a null component, no shingles
counted and kept, and links nothing. Further columns of the input are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, materialize, tidy
from tallyloom.llm.components import connected_components
from tallyloom.llm.idfilter import may_hold
from tallyloom.llm.shingles import WordHashes, shingle_set

HALF = 5  # minhashes in a half-key
SLOTS = 1 << 20  # of the counts that order shingles in clusters of several blocks


def half_keys(threshold: float, recall: float) -> int:
    """The smallest m for which a pair at the threshold shares a left and a right half-key often enough."""
    m = 1
    while (1 - (1 - threshold**HALF) ** m) ** 2 < recall:
        m += 1
    return m


def _signer(k: int, m: int, seed: int = 11):
    count = 2 * m * HALF
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, count, dtype=np.uint64)
    first = np.arange(2 * m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)
    right = (np.arange(2 * m) >= m).astype(np.uint64)  # the lowest bit tells the collection

    def sign(s: np.ndarray) -> np.ndarray:
        low = np.full(count, np.iinfo(np.uint64).max)
        for i in range(0, len(s), 512):
            part = s[i : i + 512]
            low = np.minimum(low, (a[:, None] * part[None, :] + b[:, None]).min(axis=1))
        key = first.copy()
        for j in range(HALF):
            key = (key ^ low[j::HALF]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        return (key << np.uint64(1) | right).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingle_set(text, k, known)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                out.append((doc_id, len(s), digest, sign(s) if len(s) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "keys"])

    return run


def signatures(docs: DataFrame, k: int, m: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, digest binary, keys array<long>"
    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(tidy(_signer(k, m)), schema)


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """(doc, cluster, common): documents with distinct sets that share a table bucket, directly or through others."""
    halves = reps.select("doc", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = halves.join(shared, "key").groupBy("doc").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("common"))
    live = materialize(live, "shared-halves")
    side = lambda bit: F.filter("keys", lambda x: x.bitwiseAND(F.lit(1)) == bit)
    tables = (
        live.select("doc", "common", F.explode(side(0)).alias("l"), side(1).alias("rs"))
        .select("doc", "common", "l", F.explode("rs").alias("r"))
        .select("doc", "common", F.xxhash64("l", "r").alias("bucket"))
    )
    centre = tables.groupBy("bucket").agg(F.max(F.struct("common", (-F.col("doc")).alias("neg"))).alias("c"), F.count("*").alias("n")).where("n > 1")
    edges = tables.select("bucket", "doc").join(centre.select("bucket", (-F.col("c.neg")).alias("centre")), "bucket")
    clusters = connected_components(edges.select(F.col("doc").alias("u"), F.col("centre").alias("v"))).toDF("doc", "cluster")
    return clusters.join(live.select("doc", "common"), "doc")


def _prefix(n: int, percent: int) -> int:
    """Of two alike sets, the first so many members of each, in any common order, have one in common."""
    return n - (percent * n + 99) // 100 + 1


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that span the components of a block.

    Sets meet through an index of their prefixes, rarest shingles of the block first, so unlike sets with a common
    template don't meet; full sets are intersected where the two are not connected yet. Rows of side 1 (the centre) come
    first; if there are rows of side 2, only those ask.
    """
    order = np.lexsort((ids, -side))
    ids, sets, side = ids[order], [sets[i] for i in order], side[order]
    size = np.array([len(s) for s in sets], np.int64)
    whole = np.concatenate(sets)
    vocab, code, count = np.unique(whole, return_inverse=True, return_counts=True)
    rank = np.empty(len(vocab), np.int64)
    rank[np.lexsort((vocab, count))] = np.arange(len(vocab))
    start = np.concatenate(([0], np.cumsum(size)))
    codes = [np.sort(rank[code[start[i] : start[i + 1]]]) for i in range(len(sets))]
    flat = np.concatenate(codes)
    heads = [c[: _prefix(len(c), percent)] for c in codes]
    tokens, owners = np.concatenate(heads), np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    by = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[by], owners[by]
    root = np.arange(len(sets))
    found: list[tuple[int, int]] = []
    mask = np.zeros(len(vocab), bool)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    asking = int((side == 2).sum()) or len(ids)
    for x in range(asking):
        lo, hi = np.searchsorted(tokens, heads[x], "left"), np.searchsorted(tokens, heads[x], "right")
        if int((hi - lo).sum()) <= len(lo):  # only its own entries
            continue
        met = np.unique(np.concatenate([owners[a:b] for a, b in zip(lo, hi)]))
        # Rows before an asker have asked already.
        met = met[(met > x) & (100 * size[met] >= percent * size[x]) & (100 * size[x] >= percent * size[met])]
        if not len(met):
            continue
        own = top(x)
        met = np.array([y for y in met.tolist() if top(y) != own], np.int64)
        mask[codes[x]] = True
        for i in range(0, len(met), 256):
            some = met[i : i + 256]
            both = np.array([int(mask[flat[start[y] : start[y + 1]]].sum()) for y in some.tolist()])
            for y in some[100 * both >= percent * (size[some] + size[x] - both)].tolist():
                if (a := top(y)) != (b := top(x)):
                    found.append((int(ids[x]), int(ids[y])))
                    root[max(a, b)] = min(a, b)
        mask[codes[x]] = False
    return found


def _linker(k: int, percent: int):
    """Links of each block; rows of a block come one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, key, held = WordHashes(), None, []

        def close():
            if len(held) > 1:
                ids, sets, side = zip(*held)
                found = spanning_links(np.array(ids), list(sets), np.array(side), percent)
                if found:
                    yield pd.DataFrame(found, columns=["u", "v"])

        for pdf in batches:
            for block, doc, side, text in zip(pdf["block"], pdf["doc"], pdf["side"], pdf["text"]):
                if block != key:
                    yield from close()
                    key, held = block, []
                held.append((doc, shingle_set(text, k, known), side))
        yield from close()

    return run


def _blocks(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``rows``: (block, doc, side, text) -> links (u, v)."""
    dealt = rows.select("block", "doc", "side", "text").repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(tidy(_linker(k, percent)), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = 0.9995, block: int = 400_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    ``percent``: least Jaccard similarity in hundredths, compared in integers. ``block``: shingles
    of a block, which bounds a task's memory (one longer document is a block of its own).
    """
    m = half_keys(percent / 100, recall)
    sign = materialize(signatures(docs, k, m), "signatures")
    sets = sign.groupBy("doc_id").agg(F.max(F.struct("digest", "n_shingles", "keys")).alias("s")).select("doc_id", "s.*")
    sets = materialize(sets, "sets")
    discard(sign)
    reps = sets.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("s"))
    reps = materialize(reps.select(F.col("s.doc_id").alias("doc"), "s.n_shingles", "s.keys", "digest"), "distinct-sets")
    clusters = materialize(candidate_clusters(reps).join(reps.select("doc", "n_shingles"), "doc"), "candidates")
    shape = clusters.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / F.lit(block)).cast("int").alias("blocks"), F.max(F.struct("common", (-F.col("doc")).alias("neg"))).alias("c")
    )
    clusters = clusters.join(shape.select("cluster", "blocks", (-F.col("c.neg")).alias("centre")), "cluster")
    clusters = materialize(clusters.select("doc", "cluster", "blocks", "centre", "n_shingles"), "clusters")
    texts = _candidate_texts(docs, clusters)
    own = F.array(F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    side = (F.col("doc") == F.col("centre")).cast("int")
    part = F.explode(F.when(F.col("doc") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own))
    first = texts.withColumn("part", part).select(F.xxhash64("cluster", "part").alias("block"), "doc", side.alias("side"), "text")
    links = materialize(_blocks(first, k, percent), "links")
    part = connected_components(links).toDF("doc", "part")
    big = texts.where("blocks > 1")
    if not big.isEmpty():
        more = _across_blocks(big, part, k, percent, block)
        # The new links join components: only these are contracted again.
        name = lambda c: F.coalesce(F.col(f"{c}.part"), F.col(c))
        a, b = part.toDF("u", "a"), part.toDF("v", "b")
        joined = more.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
        again = connected_components(joined).toDF("part", "whole")
        every = part.unionByName(more.select(F.explode(F.array("u", "v")).alias("doc")).distinct().join(part, "doc", "left_anti").withColumn("part", F.col("doc")))
        part = materialize(every.join(again, "part", "left").select("doc", F.coalesce("whole", "part").alias("part")), "parts")
    low = part.groupBy("part").agg(F.min("doc").alias("low"))
    part = part.join(low, "part").select("doc", "low")
    named = (
        sets.select("doc_id", "digest", "n_shingles")
        .join(reps.select("digest", "doc"), "digest", "left")
        .join(part, "doc", "left")
        .select(F.col("doc_id").alias("id"), "n_shingles", F.coalesce("low", "doc", "doc_id").alias("component_id"))
    )
    named = materialize(named, "components")
    discard(sets, reps, clusters, texts, links)
    # Rows without an id have no partner and stay out of the join, where they would be one key.
    found = docs.where("doc_id is not null").select("doc_id").join(named, F.col("doc_id") == F.col("id"), "left")
    found = found.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), "component_id")
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _candidate_texts(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``clusters`` with the texts, a row a document and text; only candidates' texts are moved."""
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null and text is not null")
    texts = texts.where(may_hold(clusters, "doc", F.col("doc")))
    # Rows that are repeated become one before they are moved; the hash stands for the text as a key.
    texts = texts.groupBy("doc", F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text")).select("doc", "text")
    # The candidates grow with the corpus: never broadcast them; hash them beside the texts.
    return materialize(texts.join(clusters.hint("shuffle_hash"), "doc"), "candidate-texts")


def _across_blocks(big: DataFrame, part: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links of documents in clusters of several blocks that aren't in the component of the cluster's centre.

    These ask, in blocks of their own. A document of the cluster goes to an asking block only if its prefix (its rarest
    shingles, of which alike sets share one) has a shingle in common with the prefix of another document that asks there.
    Any common order is exact; counts of a sample of each cluster, in SLOTS places, put the shingles of templates last.
    """
    ids = big.select("doc", "cluster", "centre", "blocks", "n_shingles").distinct().join(part, "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    hub = ids.where("doc = centre").select("cluster", F.col("part").alias("hub"))
    ids = ids.join(hub, "cluster").withColumn("out", F.col("part") != F.col("hub"))
    asking = ids.where("out").groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / F.lit(block)).cast("int").alias("of"))
    asks = F.when(F.col("out"), F.pmod(F.xxhash64(F.lit(1), "doc"), F.col("of")).cast("int")).alias("asks")
    ids = ids.join(asking, "cluster").select("doc", asks)
    rows = materialize(big.join(ids.hint("shuffle_hash"), "doc"), "open-texts")
    sample = rows.where(F.pmod(F.xxhash64(F.lit(2), "doc"), F.col("blocks")) < 2).select("text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            total = np.zeros(SLOTS, np.int64)
            for text in pdf["text"]:
                total[(shingle_set(text, k, known) % np.uint64(SLOTS)).astype(np.int64)] += 1
            at = np.flatnonzero(total)
            yield pd.DataFrame({"slot": at, "n": total[at]})

    seen = sample.mapInPandas(tidy(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int32)
    counts[seen["slot"].to_numpy(np.int64)] = np.minimum(seen["n"].to_numpy(np.int64), 2**31 - 1)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            tokens, size = [], []
            for text in pdf["text"]:
                s = shingle_set(text, k, known)
                n = _prefix(len(s), percent)
                tokens.append(s[np.lexsort((s, counts[(s % np.uint64(SLOTS)).astype(np.int64)]))[:n]].view(np.int64))
                size.append(len(tokens[-1]))
            out = {c: np.repeat(pdf[c].to_numpy(), size) for c in ("cluster", "doc", "asks", "n_shingles")}
            yield pd.DataFrame(out | {"token": np.concatenate(tokens)}).astype({"asks": "Int32"})

    tokens = rows.select("cluster", "doc", "asks", "n_shingles", "text").mapInPandas(tidy(prefixes), "cluster long, doc long, asks int, n_shingles long, token long")
    tokens = materialize(tokens, "prefixes")
    asked = tokens.where("asks is not null").groupBy("cluster", "token", F.col("asks").alias("to")).agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    met = tokens.join(asked, ["cluster", "token"]).where("a <> b or a <> doc").groupBy("cluster", "doc", "to").agg(F.first("n_shingles").alias("n"))
    met = materialize(met, "meetings")
    slices = met.groupBy("cluster", "to").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("slices"))
    given = met.join(slices, ["cluster", "to"]).select("doc", "to", F.pmod(F.xxhash64(F.lit(3), "doc"), F.col("slices")).cast("int").alias("slice"))
    other = rows.select("doc", "cluster", "asks", "text").join(given.hint("shuffle_hash"), "doc")
    ask = rows.where("asks is not null").select("doc", "cluster", F.col("asks").alias("to"), "text").join(slices, ["cluster", "to"])
    ask = ask.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    name = F.xxhash64("cluster", "to", "slice").alias("block")
    # An asker is there already: it doesn't come to its own block a second time.
    other = other.where("asks is null or asks <> to").select(name, "doc", F.lit(0).alias("side"), "text")
    more = materialize(_blocks(ask.select(name, "doc", F.lit(2).alias("side"), "text").unionAll(other), k, percent), "links")
    discard(rows, tokens, met)
    return more


def oracle(k: int = 3, percent: int = 85) -> str:
    """DuckDB SQL for ``near_duplicates``: all pairs that share a shingle, then reachability. For tables of a few thousand rows."""
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= {k} then list_transform(range(1, len(w) - {k - 2}), lambda i: {gram}) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from t),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= {percent} * (a.n + b.n - c)),
l as (select x, y from e union all select y, x from e),
r(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from r join l on r.y = l.x),
c as (select x as doc_id, min(y) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)
"""
