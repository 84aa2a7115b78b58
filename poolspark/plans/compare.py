"""Multi-target comparison: one row per target, plus the tables behind each panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.operators import report


@dataclass(frozen=True)
class Comparison:
    best: DataFrame
    auc_matrix: DataFrame
    actives_matrix: DataFrame
    auc_heatmap: DataFrame
    actives_heatmap: DataFrame
    ranks: DataFrame
    wins: DataFrame
    pareto: DataFrame
    quantiles: DataFrame
    limits: DataFrame
    correlation: DataFrame
    datasets: DataFrame


def compare_targets(
    summary: DataFrame, metadata: DataFrame, descriptors: DataFrame, columns: Sequence[str],
    round_id: int = report.REPORT_ROUND,
) -> Comparison:
    """``summary`` carries a target column; ``metadata`` is target_metadata; all keyed by target."""
    best = report.best_initialization(summary, round_id)
    return Comparison(
        best=best,
        auc_matrix=report.metric_matrix(best, "roc_auc_mean"),
        actives_matrix=report.metric_matrix(best, "actives_mean"),
        auc_heatmap=report.heatmap_cells(best, "roc_auc_mean"),
        actives_heatmap=report.heatmap_cells(best, "actives_mean"),
        ranks=report.rank_table(best),
        wins=report.win_counts(best),
        pareto=report.pareto_points(best),
        quantiles=report.descriptor_quantiles(descriptors, columns),
        limits=report.clip_limits(descriptors, columns),
        correlation=report.descriptor_correlation(descriptors, columns),
        datasets=report.dataset_table(metadata),
    )


def target_cards(comparison: Comparison, columns: Sequence[str]) -> DataFrame:
    """One row per target: dataset, ranking, best AUC and the median of each descriptor."""
    medians = comparison.quantiles.groupBy("target").pivot("descriptor", list(columns)).agg(F.first("q50"))
    medians = medians.select("target", *[F.col(c).alias(f"median_{c}") for c in columns])
    top = comparison.best.groupBy("target").agg(F.max("roc_auc_mean").alias("best_auc"))
    return (
        comparison.datasets.join(comparison.ranks, "target")
        .join(top, "target")
        .join(medians, "target")
    )


def panel_rows(comparison: Comparison) -> DataFrame:
    """Every panel beside the cards as rows (panel, target, item, x, y).

    Heat maps give a cell and its scaled value, wins a count, pareto a point, limits a range, correlation a pair of descriptors.
    """
    none = F.lit(None).cast("double")
    parts = [
        ("auc_heatmap", comparison.auc_heatmap, F.col("target"), F.col("strategy"), F.col("value"), F.col("scaled")),
        ("actives_heatmap", comparison.actives_heatmap, F.col("target"), F.col("strategy"), F.col("value"), F.col("scaled")),
        ("wins", comparison.wins, F.lit(None), F.col("strategy"), F.col("wins"), none),
        ("pareto", comparison.pareto, F.col("target"), F.col("strategy"), F.col("roc_auc_mean"), F.col("actives_mean")),
        ("limits", comparison.limits, F.lit(None), F.col("descriptor"), F.col("low"), F.col("high")),
        ("correlation", comparison.correlation, F.lit(None), F.concat_ws(" ", "a", "b"), F.col("r"), none),
    ]
    rows = None
    for panel, table, target, item, x, y in parts:
        own = table.select(
            F.lit(panel).alias("panel"), target.cast("string").alias("target"), item.alias("item"),
            x.cast("double").alias("x"), y.cast("double").alias("y"),
        )
        rows = own if rows is None else rows.unionByName(own)
    return rows
