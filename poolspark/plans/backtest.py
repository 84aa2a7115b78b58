"""Acquisition backtest: replay every campaign of a grid, round by round.

The driver loops over rounds only. One round is a grouped fit over all campaigns and one scan of
the pool that scores it for all of them; what is carried from round to round is the labeled rows.
Evaluation does not influence selection, so the models of all rounds are evaluated together in a
single scan of the test rows at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolspark.functions.ordering import order_key
from poolspark.operators import committee as qbc
from poolspark.operators.model import best_candidates, fit_campaigns, score_rows, with_features
from poolspark.operators.pool import (
    INITIAL_ROUND,
    N_INITIAL,
    TEST_SIZE,
    campaign_grid,
    init_diverse,
    init_random,
    pool_sizes,
    prepare_pool,
    running_actives,
)
from poolspark.operators.ranking import auc_by_group, hot_groups, top_k
from poolspark.operators.select import BATCH_SIZE, SHORTLIST, select_diverse_subset
from poolspark.session import cut_lineage, shared_table
from poolspark.sources.tables import spread

N_ROUNDS = 10
COMMITTEE = "query_by_committee"


@dataclass(frozen=True)
class Backtest:
    """campaigns: the grid. state: labeled rows with the round they were chosen in (-1 = initial).

    history: one row per campaign and round. models: weights per campaign and round. pool: the
    prepared pool table with its test flags.
    """

    campaigns: DataFrame
    state: DataFrame
    history: DataFrame
    models: DataFrame
    pool: DataFrame
    seeds: tuple[int, ...]


def run_backtest(
    rows: DataFrame,
    strategies: Sequence[str],
    inits: Sequence[str] = ("random",),
    seeds: Sequence[int] = (42,),
    n_initial: int = N_INITIAL,
    batch_size: int = BATCH_SIZE,
    n_rounds: int = N_ROUNDS,
    test_size: float = TEST_SIZE,
    shortlist: int = SHORTLIST,
    method: str = "xxhash64",
    trees: int = qbc.FOREST_TREES,
    boosting_rounds: int = qbc.BOOSTING_ROUNDS,
) -> Backtest:
    """``rows``: target, mol_id, label, features."""
    if shortlist < batch_size:
        raise ValueError("a batch does not fit into a shortlist of candidate_pool_size rows")
    seeds = list(seeds)
    campaigns = campaign_grid(rows, inits, strategies, seeds)
    pool = shared_table(prepare_pool(rows, seeds, test_size, method), "pool")
    dealt = spread(pool)  # every round scans the pool: a few large files are cut once, not each time
    pool = pool if dealt is pool else shared_table(dealt, "pool-spread")
    _require_enough(pool, seeds, strategies, n_initial, batch_size, n_rounds)
    campaigns = cut_lineage(campaigns)

    labeled = cut_lineage(_starting_sets(pool, campaigns, inits, seeds, n_initial, method))
    fitted = None
    for round_id in range(n_rounds + 1):
        models = cut_lineage(fit_campaigns(labeled).withColumn("round", F.lit(round_id)))
        fitted = models if fitted is None else fitted.unionByName(models)
        if round_id == n_rounds:
            break
        chosen = _choose(
            pool, campaigns, models, labeled, strategies, seeds, round_id, batch_size, shortlist, method,
            {"trees": trees, "boosting_rounds": boosting_rounds},
        )
        fresh = chosen.join(campaigns, "campaign").withColumn("round_labeled", F.lit(round_id))
        labeled = cut_lineage(labeled.unionByName(fresh.select(*labeled.columns)))

    scores = score_rows(pool, fitted, seeds, held_out=True)
    # Test rows per (target, seed) are known from the pool, so sizing the groups scores nothing.
    sizes = campaigns.join(pool_sizes(pool, seeds, held_out=True), ["target", "seed"])
    quality = auc_by_group(scores, ["campaign", "round"], hot=hot_groups(sizes, ["campaign"], weight="n"))
    history = _history(campaigns, labeled, quality, n_rounds)
    return Backtest(campaigns, labeled, history, fitted, pool, tuple(seeds))


def _require_enough(pool, seeds, strategies, n_initial, batch_size, n_rounds) -> None:
    """Random and diverse draws need a full batch in every round."""
    needed = n_initial + n_rounds * batch_size
    strict = {"random", "uncertainty_diverse"} & set(strategies)
    short = pool_sizes(pool, seeds).where(F.col("n") < needed).limit(5).collect() if strict else []
    if short:
        raise ValueError(f"{needed} rows are needed per pool, but there are too few in {short}")


def _starting_sets(pool, campaigns, inits, seeds, n_initial, method) -> DataFrame:
    """A starting set depends on (target, init, seed); all strategies share it."""
    drawn = None
    for init in dict.fromkeys(inits):
        draw = init_random if init == "random" else init_diverse
        part = draw(pool, seeds, n_initial, method).select("target", "seed", "mol_id", F.lit(init).alias("init"))
        drawn = part if drawn is None else drawn.unionByName(part)
    with_rows = drawn.join(pool.select("target", "mol_id", "label", "features"), ["target", "mol_id"])
    return with_rows.join(campaigns, ["target", "init", "seed"]).select(
        "campaign", "target", "init", "strategy", "seed", "mol_id", "label", "features",
        F.lit(INITIAL_ROUND).alias("round_labeled"),
    )


def _choose(pool, campaigns, models, labeled, strategies, seeds, round_id, batch_size, shortlist, method, sizes):
    """campaign, mol_id, label, features of this round's batch for every campaign: one scan of the pool for all."""
    keep = {s: shortlist if s == "uncertainty_diverse" else batch_size for s in strategies}
    drawn, committees = pool, None
    if "random" in strategies:
        seed_list = F.array(*[F.lit(int(s) + round_id) for s in seeds])
        drawn = pool.withColumn("draw", F.transform(seed_list, lambda s: order_key(s, F.col("mol_id"), method)))
    if COMMITTEE in strategies:
        own = labeled.where(F.col("strategy") == COMMITTEE)
        committees = shared_table(qbc.fit_committees(own, round_id, **sizes), "committees")
    found = best_candidates(drawn, models, labeled, seeds, keep, committees)
    ranked = top_k(found, ["campaign"], [F.col("score"), F.col("mol_id")], shortlist)
    ranked = cut_lineage(ranked.join(campaigns.select("campaign", "target", "strategy", "seed"), "campaign"))
    spread_out = F.col("strategy") == "uncertainty_diverse"
    rows = with_features(pool, ranked.where(spread_out | (F.col("rank") <= batch_size)))
    chosen = rows.where(~spread_out).select("campaign", "mol_id", "label", "features")
    if "uncertainty_diverse" in strategies:
        near = rows.where(spread_out).select("campaign", "seed", "mol_id", "label", "features")
        spread = select_diverse_subset(near, ["campaign"], F.col("seed") + round_id, batch_size, method=method)
        chosen = chosen.unionByName(spread.select("campaign", "mol_id", "label", "features"))
    return chosen


def _history(campaigns: DataFrame, labeled: DataFrame, quality: DataFrame, n_rounds: int) -> DataFrame:
    """Round, labeled and active counts, AUC and the rows chosen (NULL in the last round).

    A round in which a used-up pool gave no row keeps the counts of the round before.
    """
    so_far = W.partitionBy("campaign").orderBy("round")
    counts = running_actives(labeled, ["campaign"])
    rounds = campaigns.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n_rounds))))
    selected = (
        labeled.where(F.col("round_labeled") >= 0)
        .groupBy("campaign", F.col("round_labeled").alias("round"))
        .agg(F.array_sort(F.collect_list("mol_id")).alias("selected"))
    )
    return (
        rounds.join(counts, ["campaign", "round"], "left")
        .join(quality.select("campaign", "round", "roc_auc"), ["campaign", "round"], "left")
        .join(selected, ["campaign", "round"], "left")
        .select(
            "campaign", "target", F.col("init").alias("initialization_strategy"), "strategy", "seed", "round",
            *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("n_labeled", "n_actives_found")], "roc_auc", "selected",
        )
    )
