"""Phrase collocations by Suffix-sigma: every phrase of up to four words is counted by its suffixes in one shuffle.

1. Tasks cut texts into pieces and words and emit the suffix at every word, truncated to MAX_N words; equal suffixes of a
   task's buffer become one row with a count. A suffix is a string of the language and its words, each ended by a line
   feed, which neither can hold; so the suffixes that begin with one phrase are neighbours in any order of such strings.
2. Suffixes end before a rare word or a rare pair of words, as the published method splits documents at rare terms: no phrase beyond
   is frequent. A first pass counts hashes of words and pairs; those that are frequent fill a filter of bounded size
   (``MOST_BITS``), which may hold others, too: that costs rows and changes no count.
3. Suffixes are shuffled by language and first word and sorted in reverse order within the partitions. A first word that
   holds more than half a partition's share goes by its first two words, those by three, and so on; a bounded sample of
   documents tells which (``hot_prefixes``), and only the balance depends on it.
4. One stack runs down a partition: it holds the words of the current suffix with the counts of the prefixes that they end,
   and a prefix that is popped gives its count to the one below. A prefix all of whose suffixes are in one partition is
   dropped if it is rare; the counts of the others (a language's words, hot prefixes) are partial and are summed up.
5. The counts of a phrase's two parts are joined afterwards. Parts that hold more than a thousandth of all words,
   3,000 at most, are broadcast, since many phrases share them; the others are shuffled.

Scores and the comparison of phrases are exact (decimals of 38 digits).

Defined cases: null and empty texts have no words; a null language is `und`, together with the language of that name; ties in score and
count go by the phrase's bytes; repeated rows and null ids count as documents of their own; a text of any length is read in
chunks; an empty table, or one without phrases as frequent as asked for, gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import discard, materialize, tidy

MAX_N, HELD, SAMPLE, OFTEN = 4, 1_000_000, 2_000, 1_000
VOCABULARY, CHUNK, MOST_BITS = 400_000, 1 << 20, 1 << 27
#: Lower case for A-Z, a line feed for what ends a piece, a space for what ends a word.
_READ = bytes(0x0A if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else ord(chr(c).lower()) if c < 0x80 else c for c in range(256))
_MARKED = re.compile(r"\\(.)", re.S)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _tag(lang: str | None) -> str:
    """The language without line feeds; different languages have different tags."""
    return "und" if lang is None else lang.replace("\\", "\\\\").replace("\n", "\\n")


def _language(tag: str) -> str:
    return _MARKED.sub(lambda m: "\n" if m[1] == "n" else m[1], tag)


class _Ids(dict):
    """word -> number; 0 is the end of a piece, and what stands between two spaces is no word."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        return i


def blocks(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[str, np.ndarray, int, _Ids]]:
    """(tag, word numbers, how many of them to treat now, the numbering): after each number to treat there are MAX_N - 1 others.

    About ``held`` words are held at a time, whatever the texts' lengths; the numbering starts anew when it is large.
    """
    ids, waiting, size = _Ids(), {}, 0
    after = MAX_N - 1

    def cut(last: bool) -> Iterator[tuple[str, np.ndarray, int, _Ids]]:
        nonlocal ids
        rest = {}
        for tag, parts in waiting.items():
            line = np.concatenate(parts + [np.zeros(after, np.int32)] * last)
            upto = max(len(line) - after, 0)
            rest[tag] = line[upto:]
            yield tag, line, upto, ids
        waiting.clear()
        new = _Ids() if len(ids) > VOCABULARY else ids
        for tag, line in rest.items():
            if line.any():  # words that the next block goes on from
                waiting[tag] = [np.array([new[ids.words[i]] if i else 0 for i in line], np.int32)]
        ids = new

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            if not text:
                continue
            tag, text, at = _tag(lang), text.translate(_READ) + b"\n", 0
            while at < len(text):
                end = at + CHUNK
                if end < len(text):
                    found = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                    if found < 0:  # a very long word
                        found = min(i for i in (text.find(b" ", end), text.find(b"\n", end)) if i >= 0)
                    end = found + 1
                tokens = text[at:end].replace(b"\n", b" \n ").split(b" ")
                line = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
                waiting.setdefault(tag, []).append(line[line >= 0])
                size += len(tokens)
                at = end
                if size > held or len(ids) > VOCABULARY:
                    yield from cut(False)
                    size = 0
    yield from cut(True)


def _hashes(tag: str, line: np.ndarray, ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and of each pair of neighbours in their language."""
    seed = xxhash.xxh64_intdigest(tag.encode("utf-8", "surrogatepass"))
    each = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in ids.words), np.uint64, len(ids.words))
    with np.errstate(over="ignore"):
        word = each[line]
        pair = (word[:-1] * _A ^ word[1:]) * _B
        pair = (pair ^ pair >> np.uint64(31)) * _C
    return word, pair ^ pair >> np.uint64(29)


@dataclass
class Filter:
    """Bits at two places of each member's hash: never false for a member, sometimes true for others."""

    bits: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.bits) * 64 - 1)
        known = np.ones(len(h), bool)
        for p in (h & mask, h >> np.uint64(32) & mask):
            known &= (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return known


def frequent(docs: DataFrame, least: int, held: int = HELD) -> Filter:
    """The words and pairs of neighbours that occur ``least`` times: hashes are counted, so others may share their places.

    16 bits a member, MOST_BITS in all: the driver and each task hold one bounded array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tag, line, upto, ids in blocks(batches, held):
            word, pair = _hashes(tag, line, ids)
            is_word = line[:upto] > 0
            h, n = np.unique(np.concatenate((word[:upto][is_word], pair[:upto][is_word & (line[1 : upto + 1] > 0)])), return_counts=True)
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["h", "n"])

    counts = docs.select("lang", "text").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = materialize(counts.where(F.col("n") >= least).select("h"), "frequent-hashes")
    size = min(MOST_BITS, max(1 << 12, 1 << (16 * often.count()).bit_length()))
    places = F.array(F.col("h"), F.shiftrightunsigned("h", 32))
    at = often.select(F.explode(F.transform(places, lambda p: p.bitwiseAND(F.lit(size - 1)))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # size / 64 rows at most
    discard(often)
    bits = np.zeros(size >> 6, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return Filter(bits)


def _upto(c: str, mark: str, k: Column) -> Column:
    """The string before the k-th mark, or after the k-th from the end if k is negative."""
    return F.call_function("substring_index", F.col(c), F.lit(mark), k)


def route() -> Column:
    """What a suffix is dealt by: its language and first ``words`` words."""
    return _upto("suffix", "\n", F.col("words") + 1)


def _depths(tag: str, rows: list[np.ndarray], ids: _Ids, hot: frozenset[str]) -> np.ndarray:
    """By how many words each suffix is dealt: one more than its longest chain of hot prefixes."""
    depth, chain, size = np.ones(len(rows[0]), np.int32), np.ones(len(rows[0]), bool), len(ids.words)
    mine = [p.encode("utf-8", "surrogatepass").split(b"\n")[1:-1] for p in hot if p.startswith(tag + "\n")]
    for k in range(1, MAX_N):
        keys = np.zeros(len(rows[0]), object if size**k >= 2**62 else np.int64)
        for r in rows[:k]:
            keys = keys * size + r
        wanted = []
        for words in mine:
            if len(words) == k and all(w in ids for w in words):
                key = 0
                for w in words:
                    key = key * size + ids[w]
                wanted.append(key)
        chain = chain & (np.isin(keys, np.array(wanted, keys.dtype)) if wanted else False)
        depth += chain
    return depth


def suffixes(docs: DataFrame, keep: Filter | None = None, hot: frozenset[str] = frozenset(), held: int = HELD) -> DataFrame:
    """(suffix, n, words): suffixes with their counts in a buffer, and by how many of their words they are dealt.

    With ``keep`` suffixes end where a phrase can't be frequent; words that can't be are counted for their language alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tag, line, upto, ids in blocks(batches, held):
            follows = line[1:] > 0
            begins = line[:upto] > 0
            total = int(begins.sum())
            if keep is not None:
                word, pair = _hashes(tag, line, ids)
                follows &= keep.has(pair)
                begins &= keep.has(word[:upto])
            rows, alive = [line[:upto][begins].astype(np.int64)], np.ones(int(begins.sum()), bool)
            for k in range(1, MAX_N):
                alive = alive & follows[k - 1 : k - 1 + upto][begins]
                rows.append(np.where(alive, line[k : k + upto][begins], 0).astype(np.int64))
            size = len(ids.words)
            first, a = np.unique(rows[0] * size + rows[1], return_inverse=True)
            second, b = np.unique(rows[2] * size + rows[3], return_inverse=True)
            both, n = np.unique(a * len(second) + b, return_counts=True)
            head, tail = first[both // max(len(second), 1)], second[both % max(len(second), 1)]
            rows = [head // size, head % size, tail // size, tail % size]
            names = pa.array([b""] + [w + b"\n" for w in ids.words[1:]], pa.large_binary())
            depth = _depths(tag, rows, ids, hot)
            begin = pa.scalar((tag + "\n").encode("utf-8", "surrogatepass"), pa.large_binary())
            for i in range(0, len(n), 50_000):
                part = [names.take(pa.array(r[i : i + 50_000])) for r in rows]
                text = pc.binary_join_element_wise(begin, *part, pa.scalar(b"", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([text, pa.array(n[i : i + 50_000]), pa.array(depth[i : i + 50_000])], ["suffix", "n", "words"])
            if total > len(alive):
                yield pa.RecordBatch.from_pydict({"suffix": [tag + "\n"], "n": [total - len(alive)], "words": pa.array([1], pa.int32())})

    return docs.select("lang", "text").mapInArrow(tidy(run), "suffix string, n long, words int")


def hot_prefixes(docs: DataFrame, parts: int, rows: int, keep: Filter | None = None, most: int = SAMPLE) -> frozenset[str]:
    """Prefixes of one to three words with more than half a partition's share of the suffixes of about ``most`` documents.

    At most 2 * ``parts`` of each length can be. Rows are sampled one by one, so a group of copies has its share.
    """
    found = suffixes(docs if rows <= most else docs.sample(most / rows, 13), keep)
    longer = F.size(F.split("suffix", "\n")) - 2  # words of the suffix
    cut = lambda k: F.when(longer >= k, F.concat(F.substring_index("suffix", "\n", k + 1), F.lit("\n")))
    each = F.array(F.lit(""), *[cut(k) for k in range(1, MAX_N)])
    sizes = found.select(F.explode(each).alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"))
    # The empty prefix has all rows; no more than 2 * parts of each length have more than the share asked for.
    largest = sizes.orderBy(F.desc("n"), "prefix").limit(2 * (MAX_N - 1) * parts + 1).collect()
    share = max(largest[0]["n"] / (2 * parts), 1) if largest else 0
    return frozenset(r["prefix"] for r in largest if r["prefix"] and r["n"] > share)


def _runs(suffix: pa.Array, n: pa.Array) -> tuple[list[str], list[int]]:
    """Equal neighbours, which come from many buffers, as one with the sum of their counts."""
    if not len(suffix):
        return [], []
    new = np.concatenate(([True], pc.not_equal(suffix.slice(1), suffix.slice(0, len(suffix) - 1)).to_numpy(zero_copy_only=False)))
    at = np.flatnonzero(new)
    return suffix.take(pa.array(at)).to_pylist(), np.add.reduceat(n.to_numpy(), at).tolist()


def stacked(dealt: DataFrame, hot: frozenset[str], least: int) -> DataFrame:
    """(lang, phrase, words, n) of the prefixes of each partition's sorted suffixes; words = 0: the language itself.

    Rare prefixes are left out where the partition holds all of their suffixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[str] = []
        counts: list[int] = []
        out: list[tuple[str, str, int, int]] = []

        def pop(to: int) -> None:
            while len(stack) > to:
                n = counts.pop()
                partial = len(stack) == 1 or bool(hot) and "\n".join(stack) + "\n" in hot
                if partial or n >= least:
                    out.append((_language(stack[0]), " ".join(stack[1:]), len(stack) - 1, n))
                stack.pop()
                if counts:
                    counts[-1] += n

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), (), ()]
            out.clear()
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "phrase", "words", "n"])

        before = None
        for batch in batches:
            for suffix, n in zip(*_runs(batch.column("suffix"), batch.column("n"))):
                if suffix != before:
                    parts = suffix.split("\n")
                    parts.pop()
                    same, most = 0, min(len(stack), len(parts))
                    while same < most and stack[same] == parts[same]:
                        same += 1
                    pop(same)
                    stack += parts[same:]
                    counts += [0] * (len(parts) - same)
                    before = suffix
                counts[-1] += n
            yield rows()
        pop(0)
        yield rows()

    return dealt.select("suffix", "n").mapInArrow(tidy(run), "lang string, phrase string, words int, n long")


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to four words with f >= ``least``; with words = 0 the words of a language."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = frequent(docs, least)
    hot = hot_prefixes(docs, parts, docs.count(), keep)
    dealt = suffixes(docs, keep, hot).repartition(route()).sortWithinPartitions(F.desc("suffix"))
    counts = stacked(dealt, hot, least).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    return materialize(counts.where((F.col("f") >= least) | (F.col("words") == 0)), "phrase-counts")


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def part_counts(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked`` with f of (lang, part); frequent parts are broadcast, as their number is bounded (``OFTEN`` for each length)."""
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f", "words")
    total = counts.where("words = 0").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first()["n"]
    often = F.broadcast(known.where((F.col("words") < MAX_N) & (F.col("f") > total / OFTEN)).drop("words"))
    rest = asked.join(often, ["lang", "part"], "left_anti").join(known.drop("words").hint("shuffle_hash"), ["lang", "part"])
    return asked.join(often, ["lang", "part"]).unionByName(rest)


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, percent: int = 80) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, least)
    phrases = counts.where("words > 1").withColumnRenamed("f", "a")

    # Parts: phrases of four words have three cuts, so a phrase has six rows at most.
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left, right = _upto("phrase", " ", F.col("k")), _upto("phrase", " ", F.col("k") - F.col("words"))
    sides = F.array(F.struct(F.lit(0).alias("side"), left.alias("part")), F.struct(F.lit(1).alias("side"), right.alias("part")))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    ks = range(1, MAX_N)
    both = part_counts(asked, counts).groupBy("lang", "phrase", "a").agg(*[of(k, s).alias(f"f{k}{s}") for k in ks for s in (0, 1)])
    score = lambda k: F.expr(f"cast(a as decimal(20,0)) * 2000000BD div (cast(f{k}0 as decimal(20,0)) + cast(f{k}1 as decimal(20,0)))")
    cut = lambda k: F.when(
        F.col(f"f{k}0").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r"))
    )
    scored = both.select("lang", "phrase", "a", F.array_min(F.array(*[cut(k) for k in ks])).alias("c"))

    # Phrases inside a longer one that is nearly as frequent: a phrase of four words has five such parts.
    inner = F.expr(
        "filter(transform(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m)))),"
        " c -> array_join(slice(split(phrase, ' '), c.i, c.m), ' ')), p -> p != phrase)"
    )
    covered = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    covered = covered.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(covered.hint("shuffle_hash"), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * percent))

    # A language's candidates meet in one task only after each of 64 parts of them was cut to the first ones.
    order = [F.desc("c.score"), F.desc("a"), F.asc("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = kept.withColumn("deal", deal).withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("place") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def oracle(least: int = 30, top: int = 2_000, percent: int = 80) -> str:
    """DuckDB SQL of ``collocations``: all phrases are counted by brute force."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{upper}', '{lower}') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from texts),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
sizes as (select lang, sum(len(w))::bigint as n from words group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
found as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from starts, (select unnest([1, 2, 3, 4]) as m) where i + m - 1 <= len(w)),
f as (select lang, m, phrase, count(*) as f from found group by all having count(*) >= {least}),
cuts as (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1
),
scored as (
  select c.lang, c.m, c.phrase, c.a, c.k, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f::hugeint + y.f) as score
  from cuts c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select distinct lang, array_to_string(w[i:i + j - 1], ' ') as phrase, a from (
    select lang, m, string_split(phrase, ' ') as w, f as a, unnest(range(1, m + 1)) as i from f where m > 2
  ), (select unnest([2, 3]) as j) where j < m and i + j - 1 <= m
),
longest as (select lang, phrase, max(a) as longer from inner_ group by all),
kept as (
  select b.* from best b left join longest g on g.lang = b.lang and g.phrase = b.phrase
  where g.longer is null or 100::hugeint * g.longer < {percent}::hugeint * b.a
)
select k.lang, row_number() over (partition by k.lang order by k.score desc, k.a desc, k.phrase) as rank, k.phrase, k.a, k.l, k.r, s.n, k.score::bigint as score
from kept k join sizes s on s.lang = k.lang
qualify rank <= {top}
"""
