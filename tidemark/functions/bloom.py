"""Bloom filters in integer SQL arithmetic, so that any engine can rebuild the same bits.

The two hashes of a 32-bit key are the key itself and the key times the golden-ratio constant, wrapped to 32 bits; probe i
is their sum h1 + i * h2 taken as an unsigned 64-bit number modulo the filter's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_of(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, probes) for ``n`` keys at false-positive rate ``p``."""
    bits = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / max(n, 1) * math.log(2)))


def positions(key: str, bits: int, probes: int) -> Column:
    """The bit positions of an integer column, as an array of longs."""
    h2 = f"(pmod(cast({key} as bigint) * 2654435769 + 2147483648, 4294967296) - 2147483648)"
    probe = f"(cast({key} as bigint) + i * {h2})"
    wrapped = f"case when {probe} >= 0 then {probe} % {bits} else pmod(pmod({probe}, {bits}) + {2**64 % bits}, {bits}) end"
    return F.expr(f"transform(sequence(0, {probes - 1}), i -> {wrapped})")


def build(keys: DataFrame, n: int, key: str = "key", p: float = 0.01) -> DataFrame:
    """(bit): the distinct set bits of a filter for ``n`` keys."""
    bits, probes = size_of(n, p)
    return keys.select(F.explode(positions(key, bits, probes)).alias("bit")).distinct()


def may_contain(keys: DataFrame, filter_bits: DataFrame, n: int, key: str = "key", p: float = 0.01) -> DataFrame:
    """``keys`` plus maybe: whether all bits of the key are set. No false negatives; an empty filter says no."""
    bits, probes = size_of(n, p)
    asked = keys.select(key, F.explode(F.array_distinct(positions(key, bits, probes))).alias("bit"))
    hits = asked.join(filter_bits.withColumn("set", F.lit(1)), "bit", "left").groupBy(key).agg((F.count("set") == F.count("*")).alias("maybe"))
    return keys.join(hits, key, "left")
