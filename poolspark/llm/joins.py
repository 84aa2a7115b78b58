"""Joins whose small side is checked before it is broadcast, and cutting of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.session import Scratch, cut_lineage, shared_table

#: A side of at most this many narrow rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: In a shuffled join a key with more rows than this is hot: its rows are dealt over SALTS parts.
HOT_ROWS = 20_000
SALTS = 16

__all__ = ["BROADCAST_ROWS", "SALTS", "Scratch", "cut_lineage", "free_name", "join_narrow", "shared_table"]


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``tables``."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_narrow(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner",
                rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined null-safely with ``right``, a written table of narrow rows, one for each key of ``on``.

    ``right`` is counted first: up to ``rows`` it is broadcast, beyond that both sides are shuffled. The keys
    with many rows in ``left`` are counted then (their number is at most rows / HOT_ROWS); their rows are dealt
    by a hash of ``spread`` over SALTS parts, to which only their row of ``right`` is copied.
    Every way gives the same rows. The columns of ``on`` come from ``left``.
    """
    kept = [c for c in right.columns if c not in on]
    sides = {c: free_name(f"_r_{c}", left, right) for c in on}
    renamed = right.select(*[F.col(c).alias(sides[c]) for c in on], *kept)
    small = right.limit(rows + 1).count() <= rows
    if small:
        return left.join(F.broadcast(renamed), _match(sides), how).select(*left.columns, *kept)
    h, is_hot, salt = (free_name(name, left, renamed) for name in ("_h", "_hot", "_salt"))
    counts = left.groupBy(F.xxhash64(*on).alias(h)).agg(F.count("*").alias(is_hot)).where(F.col(is_hot) > HOT_ROWS)
    hot = shared_table(counts.select(h, F.lit(1).alias(is_hot)), "hot-keys")
    n = hot.count()
    if not n:
        return left.join(renamed, _match(sides), how).select(*left.columns, *kept)
    listed = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    part = F.when(F.col(is_hot) == 1, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = left.withColumn(h, F.xxhash64(*on)).join(listed, h, "left").withColumn(salt, part)
    sides[salt] = free_name(f"_r_{salt}", left, renamed)
    copies = renamed.withColumn(h, F.xxhash64(*[sides[c] for c in on])).join(listed, h, "left").withColumn(
        sides[salt], F.explode(F.sequence(F.lit(0), F.when(F.col(is_hot) == 1, SALTS - 1).otherwise(0)))).drop(h, is_hot)
    return salted.join(copies, _match(sides), how).select(*left.columns, *kept)


def _match(sides: dict[str, str]) -> Column:
    tests = [F.col(c).eqNullSafe(F.col(other)) for c, other in sides.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
