"""Hash identities and hash order: deterministic under (seed, key), whatever the input order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: object, *keys: Column) -> Column:
    """What stands for a seeded shuffle: sort by it."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash32(key: Column) -> Column:
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long")


def pair_id(question: Column, a: Column, b: Column) -> Column:
    """H1: 16 hex digits that don't depend on the order of a and b."""
    members = F.array_sort(F.array(F.concat_ws("::", question, a), F.concat_ws("::", question, b)))
    return F.substring(F.sha1(F.array_join(members, "|")), 1, 16)


def split_index(key: Column, buckets: int = 10) -> Column:
    """H2."""
    return hash32(key) % buckets


def is_synth(key: Column, below: int = 7, buckets: int = 10) -> Column:
    """H3."""
    return split_index(key, buckets) < below


def seed_for(key: Column, run: Column) -> Column:
    """H4."""
    return hash32(key).bitwiseXOR(run.cast("long"))


def prompt_hash(system: Column, user: Column) -> Column:
    """H5: sha256 of both, a NUL between them."""
    return F.sha2(F.concat(system, F.lit("\x00"), user).cast("binary"), 256)


def cache_key(pair: Column, prompt: Column, temperature: Column, swapped: Column, run: Column) -> Column:
    """H7."""
    return F.format_string("%s|%s|%.3f|%d|%d", pair, prompt, temperature, swapped.cast("int"), run)


def coin(seed: object, key: Column) -> Column:
    """A fair, repeatable coin."""
    return hash32(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))) % 2 == 1
