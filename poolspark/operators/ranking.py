"""Exact running sums, percentiles, AUC and draws that hold when one group owns most rows.

A plain window or an exact percentile gathers a whole group in one task. So group sizes are
probed first. Ordinary groups take the plain plan: one shuffle. Groups above the limit are
counted by value, written once, and cut into ordered buckets: sums over buckets are a small table
and the order inside a bucket is resolved by a window over (group, bucket). Both ways use the same
formulas and are exact, infinities included, so the limit decides only how the work is done.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolspark.functions.ordering import order_bucket
from poolspark.session import shared_table

# Groups with more rows than this are cut into buckets.
HOT_ROWS = 1_000_000
# Longest list of hot groups (64-bit hashes) that is broadcast; a longer one is joined by a salted shuffle.
BROADCAST_HOT = 100_000
SALTS = 16
# Bucket edges form a two-level search tree of FANOUT x FANOUT leaves.
FANOUT = 32


def _group_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class HotGroups:
    """Hashes of the groups, by ``keys``, that are too large for one task."""

    keys: tuple[str, ...]
    hashes: DataFrame | None

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(rows of ordinary groups, rows of hot groups or None)."""
        if self.hashes is None:
            return df, None
        tagged, on = df.withColumn("_g", _group_hash(self.keys)), ["_g"]
        if self.hashes.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT:
            listed = F.broadcast(self.hashes)
        else:
            on = ["_g", "_s"]
            tagged = tagged.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
            listed = self.hashes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return tagged.join(listed, on, "left_anti").drop(*on), tagged.join(listed, on, "left_semi").drop(*on)


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS, weight: str | None = None) -> HotGroups:
    """Find the groups with more than ``limit`` rows: one counting job that reads the keys only.

    ``keys`` may be a subset of the grouping keys used later, and ``df`` any frame whose counts
    bound theirs, if that is cheaper to read; ``weight`` names a column of row counts. Groups are
    identified by a 64-bit hash; two groups that share a hash merely go the same way.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = df.groupBy(_group_hash(keys).alias("_g")).agg(rows.alias("_n"))
    found = shared_table(sizes.where(F.col("_n") > limit).select("_g"), "hot-groups")
    return HotGroups(tuple(keys), None if found.isEmpty() else found)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """One row per (keys, value): count ``n`` plus further aggregates."""
    extra = [expr.alias(name) for name, expr in sums.items()]
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def _edges(hot: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Equi-depth bucket edges per group: ``_coarse`` (FANOUT-1) and ``_fine`` (FANOUT**2-1).

    percentile_approx merges small sketches, so no task sees the whole group.
    """
    leaves = FANOUT * FANOUT
    probs = [i / leaves for i in range(1, leaves)]
    fine = hot.groupBy(*keys).agg(F.percentile_approx(value, probs, 20 * leaves).alias("_fine"))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(FANOUT - 1)), lambda i: F.element_at("_fine", i * FANOUT))
    return fine.withColumn("_coarse", coarse)


def _leaf(value: Column) -> Column:
    """Number of edges at or below ``value``: search the coarse edges, then one slice of the fine."""
    below = lambda edges: F.size(F.filter(edges, lambda e: e <= value))
    block = F.col("_block")
    return block * FANOUT + below(F.slice(F.col("_fine"), block * FANOUT + 1, F.lit(FANOUT - 1)))


def _bucketed_sums(counted: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    """running_sums for groups too large for one task; ``counted`` should be a written table."""
    block = F.size(F.filter(F.col("_coarse"), lambda e: e <= F.col(value)))
    leafed = (
        counted.join(_edges(counted, keys, value), list(keys))
        .withColumn("_block", block)
        .withColumn("_leaf", _leaf(F.col(value)))
        .drop("_fine", "_coarse", "_block")
    )
    over_leaves = W.partitionBy(*keys).orderBy("_leaf").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        leafed.groupBy(*keys, "_leaf")
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
        .select(*keys, "_leaf", *[F.coalesce(F.sum(f"_t_{c}").over(over_leaves), F.lit(0)).alias(f"_o_{c}") for c in columns])
    )
    in_leaf = W.partitionBy(*keys, "_leaf").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = leafed.select("*", *[F.coalesce(F.sum(c).over(in_leaf), F.lit(0)).alias(f"_i_{c}") for c in columns])
    return inside.join(offsets, [*keys, "_leaf"]).select(
        *counted.columns, *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in columns]
    )


def _plain_sums(counted: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    before = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return counted.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in columns])


def running_sums(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], hot_rows: int = HOT_ROWS,
    hot: HotGroups | None = None,
) -> DataFrame:
    """One row per (keys, value) with the given sums and ``before_<name>``, the sum over smaller values.

    ``hot`` passes on an earlier probe.
    """
    usable = df.na.drop(subset=[*keys, value])
    ordinary, large = (hot or hot_groups(usable, keys, hot_rows)).split(usable)
    columns = ["n", *sums]
    plain = _plain_sums(value_counts(ordinary, keys, value, **sums), keys, value, columns)
    if large is None:
        return plain
    counted = shared_table(value_counts(large, keys, value, **sums), "value-counts")
    return plain.unionByName(_bucketed_sums(counted, keys, value, columns))


def _picked(counted: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Percentiles of bucketed groups: pick the two neighbouring ranks and interpolate."""
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    wanted = _bucketed_sums(counted, keys, value, ["n"]).join(total, list(keys))
    holds = lambda rank: (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
    parts = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        parts.append(F.max(F.when(holds(F.floor(rank)), F.col(value))).alias(f"_lo{i}"))
        parts.append(F.max(F.when(holds(F.ceil(rank)), F.col(value))).alias(f"_hi{i}"))
        parts.append(F.max(F.ceil(rank) - rank).alias(f"_v{i}"))
        parts.append(F.max(rank - F.floor(rank)).alias(f"_w{i}"))
    # As the built-in percentile does it: equal neighbours are not weighted, so infinities stay what they are.
    lo, hi, v, w = ((lambda i, c=c: F.col(f"_{c}{i}")) for c in ("lo", "hi", "v", "w"))
    values = [F.when(lo(i) == hi(i), lo(i)).otherwise(v(i) * lo(i) + w(i) * hi(i)) for i in range(len(probs))]
    found = wanted.groupBy(*keys).agg(*parts)
    return found.select(*keys, F.array(*[v.cast("double") for v in values]).alias("percentiles"))


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    hot_rows: int = HOT_ROWS,
    hot: HotGroups | None = None,
    **extra: tuple[Column, Column],
) -> DataFrame:
    """Exact percentiles with linear interpolation: keys + ``percentiles`` array<double>.

    ``extra`` adds aggregates over the rows, each as (per value, over values): the second merges
    the results of the first, as in (count(1), sum("n_meas")). ``hot`` passes on an earlier probe.
    """
    usable = df.na.drop(subset=[*keys, value])
    ordinary, large = (hot or hot_groups(usable, keys, hot_rows)).split(usable)
    array = F.array(*[F.lit(float(p)) for p in probs])
    plain = ordinary.groupBy(*keys).agg(
        F.percentile(value, array).alias("percentiles"),
        *[per_value.alias(name) for name, (per_value, _) in extra.items()],
    )
    if large is None:
        return plain
    parts = {name: per_value for name, (per_value, _) in extra.items()}
    counted = shared_table(value_counts(large, keys, value, **parts), "value-counts")
    picked = _picked(counted, keys, value, probs)
    if extra:
        merged = counted.groupBy(*keys).agg(*[over.alias(name) for name, (_, over) in extra.items()])
        picked = picked.join(merged, list(keys))
    return plain.unionByName(picked)


def auc_by_group(
    df: DataFrame, keys: Sequence[str], score: str = "p", label: str = "label", hot_rows: int = HOT_ROWS,
    hot: HotGroups | None = None,
) -> DataFrame:
    """ROC AUC per group by the rank sum with mid-ranks for ties; NULL if only one class occurs.

    Each positive beats the negatives below it and half of those it ties with.
    """
    positive = (F.col(label) == 1).cast("bigint")
    sums = {"n_pos": F.sum(positive), "n_neg": F.sum(1 - positive)}
    ranked = running_sums(df, keys, score, sums, hot_rows, hot)
    wins = F.col("n_pos").cast("double") * (F.col("before_n_neg") + F.col("n_neg") / F.lit(2.0))
    sums = ranked.groupBy(*keys).agg(
        F.sum(wins).alias("_wins"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")
    )
    pairs = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return sums.select(*keys, "n_pos", "n_neg", (F.col("_wins") / pairs).alias("roc_auc"))


def key_cutoffs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    row_id: str,
    quota: DataFrame,
    method: str = "xxhash64",
    bits: int = 12,
) -> DataFrame:
    """keys + (``cut_key``, ``cut_id``): the last row among the ``quota.take`` smallest of each group.

    Order keys are uniform, so their leading bits cut each group into even buckets. Counting the
    buckets finds the one that holds the cutoff, and only its rows (about n / 2**bits) are ranked.
    A row is taken when (order, row_id) <= (cut_key, cut_id), which needs no further shuffle of
    the data. Groups with take = 0 yield no row.
    """
    bucketed = df.select(*keys, order, row_id).withColumn("_b", order_bucket(F.col(order), method, bits))
    by_bucket = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    crossing = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)))
        .join(quota.select(*keys, "take"), list(keys))
        .where((F.col("_before") < F.col("take")) & (F.col("take") <= F.col("_before") + F.col("_n")))
        .select(*keys, "_b", (F.col("take") - F.col("_before")).alias("_rank"))
    )
    in_bucket = W.partitionBy(*keys, "_b").orderBy(order, row_id)
    return (
        bucketed.join(crossing, [*keys, "_b"])
        .withColumn("_r", F.row_number().over(in_bucket))
        .where(F.col("_r") == F.col("_rank"))
        .select(*keys, F.col(order).alias("cut_key"), F.col(row_id).alias("cut_id"))
    )


def within_cutoff(order: Column, row_id: Column) -> Column:
    cut_key, cut_id = F.col("cut_key"), F.col("cut_id")
    return F.coalesce((order < cut_key) | ((order == cut_key) & (row_id <= cut_id)), F.lit(False))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark prunes to k rows per task before the shuffle."""
    limit = k if isinstance(k, Column) else F.lit(k)
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= limit)
