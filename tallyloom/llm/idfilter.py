"""A filter of ids of bounded size, to keep most rows out of a shuffle (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26  # 8 MB


def _size(chosen: DataFrame) -> int:
    return min(MOST_BITS, max(1 << 12, 1 << (16 * chosen.count()).bit_length()))


def _bit(p: Column) -> Column:
    """The bit of a word that the last six bits of a number name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))


def _whole(words: DataFrame, n: int) -> Column:
    """One array of the words (w, b) at their places, 0 elsewhere."""
    every = words.sparkSession.range(0, n, 1, 8).select(F.col("id").cast("int").alias("w"))
    every = every.join(words.hint("shuffle_hash"), "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.array_sort(F.collect_list(F.struct("w", "b")))["b"].alias("bits")).scalar()


def may_hold(chosen: DataFrame, of: str, key: Column, bits: int | None = None) -> Column:
    """Whether ``key`` may be among the long values of ``chosen[of]``: a Bloom filter of two hashes, never false for a member.

    It has 16 bits a value, MOST_BITS at most: beyond four million values more and more others pass. The driver and each
    task hold the filter, which is one bounded array. A null key isn't a member.
    """
    if bits is None:
        bits = _size(chosen)
    place = lambda c, i: F.xxhash64(F.lit(i), c).bitwiseAND(F.lit(bits - 1))
    word = lambda p: F.shiftright(p, 6).cast("int")
    at = chosen.select(F.explode(F.array(place(F.col(of), 0), place(F.col(of), 1))).alias("p"))
    words = at.groupBy(word(F.col("p")).alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("b"))
    whole = _whole(words, bits >> 6)
    has = lambda i: F.get(whole, word(place(key, i))).bitwiseAND(_bit(place(key, i))) != 0
    return key.isNotNull() & has(0) & has(1)


def pair_filter(pairs: DataFrame, of: str, number: str, key: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """A filter like ``may_hold`` of pairs (long, int): the word of ``key``, and a test of (word, number).

    All pairs of a key are in one word, so a row looks the filter up once, whatever numbers it asks for.
    """
    n = _size(pairs) >> 6
    place = lambda k: F.xxhash64(F.lit(0), k).bitwiseAND(F.lit(n - 1)).cast("int")

    def mask(k: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(1), k, i)
        return _bit(h).bitwiseOR(_bit(F.shiftright(h, 6)))

    words = pairs.groupBy(place(F.col(of)).alias("w")).agg(F.bit_or(mask(F.col(of), F.col(number))).alias("b"))
    return F.get(_whole(words, n), place(key)), lambda word, i: word.bitwiseAND(mask(key, i)) == mask(key, i)
