"""Seeded, engine-portable randomness: md5 of ``seed|key...`` (same hex in Spark and SQL)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_key(seed: int, *cols) -> Column:
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat_ws("|", *parts)


def md5_order(seed: int, *cols) -> Column:
    """Hex string to order by (T4)."""
    return F.md5(seed_key(seed, *cols))


def md5_int(seed: int, *cols) -> Column:
    """Non-negative 60-bit integer from the first 15 hex digits of the md5."""
    return F.conv(F.substr(md5_order(seed, *cols), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def distinct_draws(seed: int, size: Column, n: int, *cols) -> Column:
    """Floyd's method: min(n, size) distinct numbers below ``size`` (an array), every subset equally likely.

    Step i takes a hash of the seed, the key and i below size - m + i + 1, or, if that is taken, size - m + i itself.
    """
    m = F.least(F.lit(n), size)

    def step(taken: Column, i: Column) -> Column:
        last = size - m + i
        drawn = F.pmod(md5_int(seed, *cols, i), last + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, drawn), last).otherwise(drawn).cast("bigint"))

    steps = F.when(m > 0, F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps.cast("array<bigint>"), F.array().cast("array<bigint>"), step)
