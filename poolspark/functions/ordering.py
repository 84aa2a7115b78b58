"""Keyed pseudo-random order: a draw is "the rows with the smallest key".

The key depends on (seed, id) alone, so a draw is the same under any partitioning and after a
task is retried. Both forms give a 64-bit integer that is uniform enough to be split into
buckets by its leading bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: Column, row_id: Column, method: str = "xxhash64") -> Column:
    """``xxhash64`` is the fast form; ``md5`` (leading 60 bits) can be repeated in any SQL engine."""
    text = F.concat_ws(":", seed.cast("string"), row_id.cast("string"))
    if method == "xxhash64":
        return F.xxhash64(text)
    if method == "md5":
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    raise ValueError("method must be one of: 'xxhash64', 'md5'")


def order_bucket(key: Column, method: str = "xxhash64", bits: int = 12) -> Column:
    """Monotone bucket number of an order key: 2**bits buckets of equal expected size."""
    if method == "xxhash64":
        return F.shiftright(key, 64 - bits).cast("int")
    return F.shiftright(key, 60 - bits).cast("int")
