"""Row tables behind the campaign and projection panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.operators import pool, report, space
from poolspark.plans.backtest import Backtest
from poolspark.session import shared_table


def campaign_state(run: Backtest) -> DataFrame:
    """Every pool row of every campaign with the round it was labeled in (NULL = untested).

    Derived when a panel needs it; a backtest itself stores labeled rows only.
    """
    rows = run.pool.select("target", "mol_id", "label", "test_mask").join(run.campaigns, "target")
    seed_no = F.array_position(F.array(*[F.lit(s) for s in run.seeds]), F.col("seed")).cast("int")
    rows = rows.where(~F.element_at("test_mask", seed_no)).drop("test_mask")
    labeled = run.state.select("campaign", "mol_id", "round_labeled")
    return rows.join(labeled, ["campaign", "mol_id"], "left")


def campaign_panel(run: Backtest, projected: DataFrame, round_id: int) -> DataFrame:
    """Tags, coordinates, metric annotation and display label of every campaign at a round."""
    tagged = pool.truth_tags(pool.state_at_round(campaign_state(run), round_id))
    tagged = tagged.withColumnRenamed("init", "initialization_strategy").withColumnRenamed("label", "active")
    points = projected.select(
        "target", "mol_id", F.element_at("embedding", 1).alias("pc1"), F.element_at("embedding", 2).alias("pc2")
    )
    placed = space.overlay(tagged, points, ["target", "mol_id"])
    return report.attach_metric(placed, report.summarize(run.history), round_id)


def campaign_layers(run: Backtest, projected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panels of all campaigns and rounds as (points, marks): what a panel shows is the points of its target, under its marks.

    points: target, mol_id, active, pc1, pc2, once per target whatever the number of campaigns. marks: the rows a campaign has
    labeled, each from the round on in which it is first shown (``from_round``), with its tag, coordinates, and the metric of its
    (init, strategy) at that round. Rows without a mark up to a round are untested in it.
    """
    points = projected.select(
        "target", "mol_id", F.col("label").alias("active"), F.element_at("embedding", 1).alias("pc1"), F.element_at("embedding", 2).alias("pc2"),
    )
    tagged = pool.state_at_round(run.state.drop("features"), F.col("round_labeled") + 1)
    labeled = tagged.select(
        "campaign", "target", F.col("init").alias("initialization_strategy"), "strategy", "mol_id", "tag",
        F.greatest(F.lit(0), F.col("round_labeled") + 1).alias("from_round"),
    )
    marks = space.overlay(labeled, points, ["target", "mol_id"])
    summary = report.summarize(run.history).select("target", "initialization_strategy", "strategy", F.col("round").alias("from_round"), "roc_auc_mean")
    return points, marks.join(summary, ["target", "initialization_strategy", "strategy", "from_round"], "left")


def projection_panel(projected: DataFrame, variance: DataFrame, neighbours: DataFrame | None = None):
    """(projection rows with the variance their two components explain in their target, variance table, neighbour edges)."""
    rows = space.projection_rows(projected, ["target", "mol_id"])
    share = variance.select("target", F.concat(F.lit("PC"), "component").alias("axis"), "explained")
    per_pair = [
        share.where(F.col("axis").isin(f"PC{i}", f"PC{j}")).groupBy("target").agg(F.sum("explained").alias("variance"))
        .withColumn("pair", F.lit(f"PC{i}-PC{j}"))
        for i, j in space.PANEL_PAIRS
    ]
    shares = per_pair[0]
    for more in per_pair[1:]:
        shares = shares.unionByName(more)
    return rows.join(shares, ["target", "pair"], "left"), variance, neighbours


def neighbour_panel(edges: DataFrame, projected: DataFrame, row_id: str = "mol_id") -> DataFrame:
    """The neighbour map drawn on the first two components: every edge with the coordinates and labels of both ends."""

    # Written once: both ends read the coordinates, and a projection makes them from all features.
    x, y = (F.element_at("embedding", i).alias(name) for i, name in ((1, "x"), (2, "y")))
    points = shared_table(projected.select(F.col(row_id).alias("at"), x, y, "label"), "points")

    def end(name):
        return points.select(F.col("at").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("x", "y", "label")])

    return edges.join(end("src"), "src").join(end("dst"), "dst")


def experiment_card(rows: DataFrame, summary: DataFrame, variance: DataFrame, round_id: int) -> DataFrame:
    """A row per target: size, active fraction, best (init, strategy) with its AUC band, variance of its own first components."""
    totals = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("active_fraction"))
    best = report.best_campaign(summary, round_id).select(
        "target", "initialization_strategy", "strategy", "roc_auc_mean", "roc_auc_std", F.col("round")
    )
    card = totals.join(best, "target")
    for n in (2, 3):
        card = card.join(space.share_of_variance(variance, up_to=n), "target", "left")
    return card
