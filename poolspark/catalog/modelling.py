"""Registered queries: AUC, fits, scoring and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolspark.catalog import standins as st
from poolspark.operators import committee, model, pool, select
from poolspark.operators.ranking import auc_by_group
from poolspark.plans.backtest import run_backtest
from poolspark.session import cut_lineage, shared_table

QUERIES = {}
SQL = {}


def auc(spark, sf_dir):
    return auc_by_group(st.scored(spark, sf_dir), ["seed", "target"]).withColumn("roc_auc", F.round("roc_auc", 6))


QUERIES["auc_by_group"] = auc
SQL["auc_by_group"] = f"""WITH {st.SCORED_SQL},
r AS (SELECT seed, target, label, rank() OVER (PARTITION BY seed, target ORDER BY p)
    + (count(*) OVER (PARTITION BY seed, target, p) - 1) / 2.0 AS mid FROM scored),
s AS (SELECT seed, target, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg,
    sum(CASE WHEN label = 1 THEN mid END) AS ranks FROM r GROUP BY seed, target)
SELECT seed, target, n_pos, n_neg, round((ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS roc_auc FROM s"""

FIT_SEEDS = st.SEEDS


def fit_score(spark, sf_dir):
    """One model per (target, seed) on its random starting set; P(active) of every pool row."""
    prepared = shared_table(pool.prepare_pool(st.pool(spark, sf_dir), FIT_SEEDS), "pool")
    grid = pool.campaign_grid(prepared, ["random"], ["greedy"], FIT_SEEDS)
    drawn = pool.init_random(prepared, FIT_SEEDS).select("target", "seed", "mol_id")
    labeled = drawn.join(prepared, ["target", "mol_id"]).join(grid, ["target", "seed"])
    models = model.fit_campaigns(labeled).withColumn("round", F.lit(0))
    scored = model.score_rows(prepared, models, FIT_SEEDS, held_out=False)
    return scored.withColumn("p", F.round("p", 6))


QUERIES["fit_score"] = fit_score


def history_columns(run):
    return run.history.select(
        "campaign", "target", "initialization_strategy", "strategy", "seed", "round", "n_labeled", "n_actives_found",
        F.round("roc_auc", 6).alias("roc_auc"), F.array_join(F.col("selected").cast("array<string>"), ",").alias("selected"),
    )


def full_run(spark, sf_dir, strategies=pool.STRATEGIES):
    """Both initializations, five seeds, ten rounds, committees of 300 trees and 100 boosting rounds."""
    return run_backtest(st.pool(spark, sf_dir), list(strategies), pool.INITIALIZATIONS, FIT_SEEDS)


QUERIES["backtest"] = lambda spark, sf_dir: history_columns(full_run(spark, sf_dir))
QUERIES["committee_backtest"] = lambda spark, sf_dir: history_columns(full_run(spark, sf_dir, ["query_by_committee"]))


def trained_committees(spark, sf_dir):
    """The pool, and a committee per (target, seed) trained on its random starting set."""
    prepared = shared_table(pool.prepare_pool(st.pool(spark, sf_dir), FIT_SEEDS), "pool")
    grid = pool.campaign_grid(prepared, ["random"], ["query_by_committee"], FIT_SEEDS)
    drawn = pool.init_random(prepared, FIT_SEEDS).select("target", "seed", "mol_id")
    labeled = cut_lineage(drawn.join(prepared, ["target", "mol_id"]).join(grid, ["target", "seed"]))
    return prepared, labeled, shared_table(committee.fit_committees(labeled), "committees")


def committee_scores(spark, sf_dir):
    """P(active) by each member of a trained committee and their disagreement, for every pool row."""
    prepared, _, committees = trained_committees(spark, sf_dir)
    scored = committee.with_disagreement(model.score_committees(prepared, committees, FIT_SEEDS))
    members = [F.round(F.col("member_p")[i]["p"], 6).alias(f"p_{name}") for i, name in enumerate(committee.MEMBERS)]
    return scored.select("campaign", "mol_id", "label", *members, F.round("disagreement", 6).alias("disagreement"))


def committee_diagnostics(spark, sf_dir):
    """Every pool row with the disagreement of a trained committee (0 where labeled), and the next batch."""
    prepared, labeled, committees = trained_committees(spark, sf_dir)
    rows = shared_table(committee.with_disagreement(model.score_committees(prepared, committees, FIT_SEEDS)).drop("member_p"), "disagreement")
    fresh = rows.join(labeled.select("campaign", "mol_id"), ["campaign", "mol_id"], "left_anti")
    chosen = select.select_query_by_committee(fresh, ["campaign"])
    out = committee.diagnostics(rows.drop("disagreement"), fresh, chosen, ["campaign", "mol_id"])
    return out.withColumn("disagreement", F.round("disagreement", 6))


QUERIES["committee_scores"] = committee_scores
QUERIES["committee_diagnostics"] = committee_diagnostics


def history_union(spark, sf_dir):
    """Histories kept per initialization, put together again."""
    history = st.history(spark, sf_dir)
    parts = [history.where(F.col("initialization_strategy") == i) for i in pool.INITIALIZATIONS]
    return parts[0].unionByName(parts[1]).withColumn("roc_auc", F.round("roc_auc", 6))


QUERIES["history_union"] = history_union
SQL["history_union"] = f"WITH {st.HISTORY_SQL} SELECT * REPLACE (round(roc_auc, 6) AS roc_auc) FROM history"
