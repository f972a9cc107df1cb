"""Randomness as a function of the row key.

A draw hashes the key with md5, so it is the same on every engine, on every
attempt of a task and for every partitioning.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def key_text(*parts: Column | int | str) -> Column:
    """The parts of a key joined into one text; plain values are literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(SEPARATOR, *[c.cast("string") for c in cols])


def order_key(*parts: Column | int | str) -> Column:
    """A text to sort by for a reproducible random order."""
    return F.md5(key_text(*parts))


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return word(order_key(*parts), F.lit(0))


def word(digest: Column, which: Column) -> Column:
    """One of the four 32-bit words of an md5 text as a number in [0, 1)."""
    bits = F.conv(F.substr(digest, which * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    return bits / F.lit(4294967296.0)


def integer(low: Column, high: Column, *parts: Column | int | str) -> Column:
    """An integer in ``low..high``, both included."""
    return (low + F.floor(uniform(*parts) * (high - low + 1))).cast("int")


def poisson_thresholds(terms: int = 14) -> list[float]:
    """Cumulative probabilities of the Poisson distribution with mean 1."""
    return [math.fsum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(terms)]


def poisson_of_word(word_text: Column) -> Column:
    """``poisson`` of eight hex digits of an md5 text. Such texts have the order of their
    numbers, so they are compared as they stand, mostly with the first two bounds."""
    bounds = [math.ceil(limit * 2**32) for limit in poisson_thresholds()]
    count = F.when(word_text < format(bounds[0], "08x"), 0)
    for k, bound in enumerate(bounds[1:], start=1):
        if bound < 2**32:
            count = count.when(word_text < format(bound, "08x"), k)
    return count.otherwise(sum(b < 2**32 for b in bounds))


def poisson(u: Column) -> Column:
    """Poisson(1) count of a uniform number, by inversion."""
    return reduce(
        lambda acc, limit: acc + F.when(u >= limit, 1).otherwise(0), poisson_thresholds(), F.lit(0)
    )
