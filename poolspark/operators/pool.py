"""Campaign grid, train/test split, starting sets and pool state.

A campaign is one (target, initialization, strategy, seed). Its labeled rows are the only state
that is kept: a few per campaign. Test membership is a comparison with a cutoff, and "unlabeled"
is what is left of the pool, so no table of campaigns x rows is ever written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolspark.functions.ordering import order_key
from poolspark.operators.matrix import farthest_while, nearest_squared, target_slices
from poolspark.operators.ranking import key_cutoffs, top_k, within_cutoff
from poolspark.session import BROADCAST_BYTES, cut_lineage, dealt_by

# Fixed values.
INITIALIZATIONS = ("random", "diverse")
STRATEGIES = ("greedy", "random", "uncertainty_topk", "uncertainty_diverse", "query_by_committee")
TEST_SIZE = 0.2
N_INITIAL = 20
INITIAL_ROUND = -1

# Rows per group that a pass of the farthest-point start looks at closely.
CANDIDATES = 512
# Narrow candidate rows that are sent to the pool; with more, both sides are shuffled.
BROADCAST_CANDIDATES = 500_000
# Cutoffs that are sent to the rows of the pool; with more, both sides are shuffled.
BROADCAST_CUTOFFS = 500_000


def check_names(kind: str, given: Sequence[str], known: Sequence[str]) -> None:
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown {kind} {unknown}, known are {list(known)}")


def campaign_grid(
    targets: DataFrame, inits: Sequence[str], strategies: Sequence[str], seeds: Sequence[int]
) -> DataFrame:
    """Every combination, with a readable key. The short lists are exploded, nothing is joined."""
    check_names("initialization", inits, INITIALIZATIONS)
    check_names("strategy", strategies, STRATEGIES)
    options = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    grid = (
        targets.select("target")
        .distinct()
        .withColumn("init", options(inits))
        .withColumn("strategy", options(strategies))
        .withColumn("seed", options(seeds))
    )
    return grid.select(
        F.concat_ws("/", "target", "init", "strategy", F.col("seed").cast("string")).alias("campaign"), "*"
    )


def test_quota(counts: DataFrame, keys: Sequence[str], label: str, test_size: float = TEST_SIZE) -> DataFrame:
    """Test rows per class: ceil(test_size * n) in all, shared out by largest remainder.

    ``counts`` has one row per (keys, label) with the class size ``n``.
    """
    group = W.partitionBy(*keys)
    total = F.ceil(F.sum("n").over(group) * F.lit(test_size))
    shared = counts.withColumn("_total", total).withColumn(
        "_share", F.col("n").cast("double") * F.col("_total") / F.sum("n").over(group)
    )
    shared = shared.withColumn("_whole", F.floor("_share"))
    left = F.col("_total") - F.sum("_whole").over(group)
    rank = F.row_number().over(group.orderBy(F.desc(F.col("_share") - F.col("_whole")), label))
    return shared.select(*keys, label, "n", (F.col("_whole") + (rank <= left).cast("int")).cast("bigint").alias("take"))


def split_cutoffs(
    keyed: DataFrame, keys: Sequence[str], label: str = "label", row_id: str = "mol_id",
    test_size: float = TEST_SIZE, method: str = "xxhash64", order: str = "order_key",
) -> DataFrame:
    """Per (keys, label): the order key and id up to which a row belongs to the test set."""
    counts = keyed.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    quota = test_quota(counts, keys, label, test_size)
    return key_cutoffs(keyed, [*keys, label], order, row_id, quota, method)


def meet_cutoffs(rows: DataFrame, cuts: DataFrame, on: Sequence[str], n_cuts: Column) -> DataFrame:
    """``rows`` with the columns of ``cuts``, which has one row for each value of ``on``; NULL where it has none.

    The cutoffs are computed and counted (``n_cuts`` of them in a row) first. Up to BROADCAST_CUTOFFS they
    go to the rows, so the pool and its features stay where they are, however many rows a group has.
    """
    cuts = cut_lineage(cuts)
    few = cuts.agg(F.coalesce(F.sum(n_cuts), F.lit(0))).first()[0] <= BROADCAST_CUTOFFS
    return rows.join(F.broadcast(cuts) if few else cuts, list(on), "left")


def stratified_split(
    df: DataFrame, keys: Sequence[str], seed: str = "seed", label: str = "label", row_id: str = "mol_id",
    test_size: float = TEST_SIZE, method: str = "xxhash64",
) -> DataFrame:
    """Adds ``split`` = 'test' | 'pool': exact stratified draw per (keys, seed), no group in one task."""
    keyed = df.withColumn("order_key", order_key(F.col(seed), F.col(row_id), method))
    cuts = split_cutoffs(keyed, [*keys, seed], label, row_id, test_size, method)
    tested = within_cutoff(F.col("order_key"), F.col(row_id))
    return (
        meet_cutoffs(keyed, cuts, [*keys, seed, label], F.lit(1))
        .withColumn("split", F.when(tested, "test").otherwise("pool"))
        .select(*df.columns, "split")
    )


def require_larger(counts: DataFrame, n_initial: int) -> None:
    """Every group (one row with its size ``n``) must exceed the starting set."""
    small = counts.where(F.col("n") <= n_initial).limit(5).collect()
    if small:
        raise ValueError(f"a start of {n_initial} rows leaves nothing to choose from in {small}")


def prepare_pool(
    df: DataFrame, seeds: Sequence[int], test_size: float = TEST_SIZE, method: str = "xxhash64"
) -> DataFrame:
    """target, mol_id, label, features + ``test_mask``: one flag per seed, TRUE = held out for testing.

    Rows are not repeated per seed: membership is worked out against one cutoff per
    (target, class, seed), and only ids and keys pass through the cutoff job.
    """
    seed_list = F.array(*[F.lit(int(s)) for s in seeds])
    ids = df.select("target", "label", "mol_id", F.posexplode(seed_list).alias("seed_no", "seed"))
    keyed = ids.withColumn("order_key", order_key(F.col("seed"), F.col("mol_id"), method))
    cuts = split_cutoffs(keyed, ["target", "seed_no"], test_size=test_size, method=method)
    per_class = cuts.groupBy("target", "label").agg(
        F.array_sort(F.collect_list(F.struct("seed_no", "cut_key", "cut_id"))).alias("_cuts")
    )
    seed_of = lambda cut: F.element_at(seed_list, cut["seed_no"] + 1)

    def held_out(cut: Column) -> Column:
        key = order_key(seed_of(cut), F.col("mol_id"), method)
        return (key < cut["cut_key"]) | ((key == cut["cut_key"]) & (F.col("mol_id") <= cut["cut_id"]))

    none = F.array_repeat(F.lit(False), len(seeds))
    return meet_cutoffs(df, per_class, ["target", "label"], F.size("_cuts")).select(
        "target", "mol_id", "label", "features", F.coalesce(F.transform("_cuts", held_out), none).alias("test_mask")
    )


def without_test(df: DataFrame, n_seeds: int) -> DataFrame:
    """A pool table in which no row is held out for any seed."""
    mask = F.array_repeat(F.lit(False), n_seeds)
    return df.select("target", "mol_id", "label", "features", mask.alias("test_mask"))


def _starting_keys(pool: DataFrame, seeds: Sequence[int], method: str, *columns: str) -> DataFrame:
    """(target, seed_no, seed, mol_id, _k) of every pool row and every seed it is not held out for."""
    seed_list = F.array(*[F.lit(int(s)) for s in seeds])
    rows = pool.select("target", "mol_id", *columns, "test_mask", F.posexplode(seed_list).alias("seed_no", "seed"))
    open_rows = rows.where(~F.element_at("test_mask", F.col("seed_no") + 1)).drop("test_mask")
    start = F.concat(F.col("seed").cast("string"), F.lit("-init"))
    return open_rows.withColumn("_k", order_key(start, F.col("mol_id"), method))


def pool_sizes(pool: DataFrame, seeds: Sequence[int], held_out: bool = False) -> DataFrame:
    """Rows available (or held out) per (target, seed), counted in one pass without repeating rows per seed."""
    counted = pool.groupBy("target").agg(
        *[F.count(F.when(F.element_at("test_mask", i + 1) == F.lit(held_out), 1)).alias(str(s)) for i, s in enumerate(seeds)]
    )
    long = counted.unpivot("target", [str(s) for s in seeds], "seed", "n")
    return long.withColumn("seed", F.col("seed").cast("int"))


def init_random(
    pool: DataFrame, seeds: Sequence[int], n_initial: int = N_INITIAL, method: str = "xxhash64"
) -> DataFrame:
    """target, seed, mol_id, ``rank`` 1..n: a draw without replacement per (target, seed)."""
    require_larger(pool_sizes(pool, seeds), n_initial)
    keyed = _starting_keys(pool, seeds, method)
    drawn = top_k(keyed, ["target", "seed"], [F.col("_k"), F.col("mol_id")], n_initial)
    return drawn.select("target", "seed", "mol_id", "rank")


def init_diverse(
    pool: DataFrame, seeds: Sequence[int], n_initial: int = N_INITIAL, method: str = "xxhash64", candidates: int = CANDIDATES
) -> DataFrame:
    """target, seed, mol_id, features, ``rank`` 1..n: farthest-point start per (target, seed); ties go to the smallest id.

    A pass over the pool finds, for all groups at once, the ``candidates`` rows farthest from the centres so far and how far the next
    row is. A row only comes nearer as centres are added, so as long as the farthest candidate is farther than that bound it is
    the farthest row of the whole pool: a pass yields many centres, not one, and distances to a centre are computed once for
    each pass that follows it. Where one row a pass is all that can be told, the result is the same.
    """
    require_larger(pool_sizes(pool, seeds), n_initial)
    keyed = _starting_keys(pool, seeds, method, "features")
    first = F.min_by(F.struct("mol_id", "features"), F.struct("_k", "mol_id")).alias("_f")
    centres = keyed.groupBy("target", "seed").agg(first).select("target", "seed", "_f.*", F.lit(1).alias("rank"))
    centres = cut_lineage(centres)
    while True:
        open_groups = centres.groupBy("target", "seed").agg(F.max("rank").alias("have")).where(F.col("have") < n_initial)
        current = cut_lineage(centres.join(open_groups, ["target", "seed"]))
        if current.isEmpty():
            return centres
        centres = cut_lineage(centres.unionByName(more_centres(pool, current, seeds, n_initial, candidates)))


def more_centres(pool: DataFrame, centres: DataFrame, seeds: Sequence[int], n_initial: int, candidates: int) -> DataFrame:
    """The next centres of every group of ``centres`` (target, seed, mol_id, features, have), at least one for each."""
    far = farthest_rows(pool, centres.drop("have", "rank"), seeds, candidates + 1)
    bound = F.max(F.when(F.col("rank") > candidates, F.col("near"))).over(W.partitionBy("target", "seed"))
    far = far.withColumn("bound", bound).where(F.col("rank") <= candidates).join(centres.select("target", "seed", "have").distinct(), ["target", "seed"])
    far = cut_lineage(far.drop("rank"))  # ids and distances; features are looked up for these rows only
    narrow = F.broadcast(far) if far.count() <= BROADCAST_CANDIDATES else far
    rows = pool.select("target", "mol_id", "features").join(narrow, ["target", "mol_id"])

    def extend(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("mol_id")
        have, bound = int(group["have"].iloc[0]), group["bound"].iloc[0]
        order = farthest_while(np.stack(group["features"].to_list()), group["near"].to_numpy(copy=True), n_initial - have, -np.inf if pd.isna(bound) else float(bound))
        return group.iloc[order][["target", "seed", "mol_id", "features"]].assign(rank=np.arange(have + 1, have + 1 + len(order), dtype="int32"))

    return dealt_by(rows, "target", "seed").applyInPandas(extend, "target string, seed int, mol_id bigint, features array<double>, rank int")


def farthest_rows(pool: DataFrame, centres: DataFrame, seeds: Sequence[int], n: int) -> DataFrame:
    """target, seed, mol_id, near, rank: per group the ``n`` pool rows whose nearest centre is farthest away, centres excluded.

    A task keeps the n best rows per group it has seen, ids and squared distances only. Centres are read on the driver and
    broadcast, as MLlib does for k-means, in blocks of whole groups of at most BROADCAST_BYTES, each dropped after its scan.
    """
    found = None
    ordered = centres.orderBy("target", "seed", "mol_id").select("target", "seed", "mol_id", "features")
    for block in blocks(ordered.toLocalIterator(), ("target", "seed"), BROADCAST_BYTES):
        groups: dict[str, list] = {}
        for (target, seed), rows in block:
            ids = np.array([r["mol_id"] for r in rows])
            x = np.array([r["features"] for r in rows], dtype=np.float64)
            groups.setdefault(target, []).append((list(seeds).index(seed), seed, ids, x))
        shared = pool.sparkSession.sparkContext.broadcast(groups)
        part = cut_lineage(_farthest_block(pool, shared, n))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return top_k(found, ["target", "seed"], [F.desc("near"), F.col("mol_id")], n)


def feature_bytes(row) -> int:
    return 8 * (len(row["features"]) + 4)


def blocks(
    rows: Iterable, keys: Sequence[str], limit: int, cost_of: Callable[[object], int] = feature_bytes
) -> Iterator[list[tuple[tuple, list]]]:
    """Whole groups of rows sorted by ``keys``, packed into blocks of about ``limit`` bytes."""
    block, size = [], 0
    for key, members in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        members = list(members)
        cost = sum(cost_of(r) for r in members)
        if block and size + cost > limit:
            yield block
            block, size = [], 0
        block.append((key, members))
        size += cost
    if block:
        yield block


FARTHEST_SCHEMA = "target string, seed int, mol_id bigint, near double"


def _farthest_block(pool: DataFrame, shared, n: int) -> DataFrame:
    def scan(batches):
        best: dict[tuple, tuple] = {}
        for batch in batches:
            for target, at, x, ids, mask in target_slices(batch):
                for seed_no, seed, centre_ids, centre_x in shared.value.get(target, ()):
                    rows = np.flatnonzero(~mask[:, seed_no] & ~np.isin(ids, centre_ids))
                    new = (nearest_squared(x[rows], centre_x), ids[rows])
                    old = best.get((target, seed))
                    if old is not None:
                        new = tuple(np.concatenate([a, c]) for a, c in zip(old, new))
                    order = np.lexsort((new[1], -new[0]))[:n]
                    best[target, seed] = tuple(part[order] for part in new)
        for (target, seed), (near, ids) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_pydict(
                    {"target": [target] * len(ids), "seed": pa.array([seed] * len(ids), pa.int32()), "mol_id": ids, "near": near})

    return pool.select("target", "mol_id", "features", "test_mask").mapInArrow(scan, FARTHEST_SCHEMA)


def unlabeled(pool: DataFrame, labeled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pool rows that are not labeled (set difference on the keys)."""
    return pool.join(labeled.select(*keys), list(keys), "left_anti")


def reveal_labels(state: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of the rows a campaign has tested."""
    return state.where(F.col("round_labeled").isNotNull()).join(labels, list(keys))


def update_pool(state: DataFrame, selection: DataFrame, keys: Sequence[str], round_id: Column) -> DataFrame:
    """Marks the selected rows as labeled in this round; rows labeled before keep their round."""
    chosen = selection.select(*keys).distinct().withColumn("_chosen", F.lit(True))
    fresh = F.when(F.col("_chosen"), round_id)
    return (
        state.join(chosen, list(keys), "left")
        .withColumn("round_labeled", F.coalesce("round_labeled", fresh))
        .drop("_chosen")
    )


def state_at_round(state: DataFrame, target_round: int | Column) -> DataFrame:
    """Campaign view before round ``target_round``: Untested, Initial, New active or New inactive."""
    at = F.col("round_labeled")
    new = at.isNotNull() & (at >= 0) & (at < target_round)
    tag = (
        F.when(at == INITIAL_ROUND, "Initial")
        .when(new & (F.col("label") == 1), "New active")
        .when(new, "New inactive")
        .otherwise("Untested")
    )
    return state.withColumn("tag", tag)


def truth_tags(state: DataFrame) -> DataFrame:
    """Ground-truth view: 4-way tag, and the 3-way one that hides the truth of unlabeled rows."""
    tested = F.col("round_labeled").isNotNull()
    activity = F.when(F.col("label") == 1, "active").otherwise("inactive")
    four = F.concat_ws(" ", F.when(tested, "labeled").otherwise("unlabeled"), activity)
    return state.withColumn("truth_tag", four).withColumn("open_tag", F.when(tested, four).otherwise("unlabeled"))


def running_actives(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per round: rows labeled before it and actives among them (round 0 sees the starting set)."""
    per_round = (
        state.where(F.col("round_labeled").isNotNull())
        .groupBy(*keys, (F.col("round_labeled") + 1).cast("int").alias("round"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_a"))
    )
    past = W.partitionBy(*keys).orderBy("round").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_round.select(
        *keys, "round", F.sum("_n").over(past).alias("n_labeled"), F.sum("_a").over(past).alias("n_actives_found")
    )
